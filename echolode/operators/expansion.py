"""EXP: functions with the code of the local functions they call.

Syntax trees give facts (calls, bindings, returned classes, imports); who is called is found by equi-joins on (file, key)
with one row a symbol, so that no join multiplies rows. Each level of depth is one pass of these joins over the functions
that the level before has added, written to the shared folder.

Choices: among files of one name the last path counts, among files with one module suffix the first; calls are taken in
the order of the source. Helpers that would go over ``max_chars`` are passed over, later and shorter ones are not. Names
are looked up from the file of the function that is expanded, for its helpers' calls as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Expansion
from ..functions import calls as K
from .scratch import Scratch
from .snippets import OUT, _normalised

CALL = "struct<form:string,base:string,name:string>"
BIND = "struct<var:string,form:string,base:string,name:string>"
STATE = "struct<chars:long,seen:array<string>,picked:array<struct<fn_id:string,qualified_name:string>>>"


def function_facts(units: DataFrame) -> DataFrame:
    """calls, binds and made of each function."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["calls"], part["binds"], part["made"] = zip(*map(K.facts, part.pop("code")), strict=True) if len(part) else ((), (), ())
            for column, names in (("calls", ("form", "base", "name")), ("binds", ("var", "form", "base", "name"))):
                part[column] = [[dict(zip(names, row, strict=True)) for row in rows] for rows in part[column]]
            yield part

    schema = f"fn_id string, path string, qualified_name string, fn_ord int, calls array<{CALL}>, binds array<{BIND}>, made string"
    return units.select("fn_id", "path", "qualified_name", "fn_ord", "code").mapInPandas(run, schema)


def import_facts(files: DataFrame) -> DataFrame:
    """One row an imported name, in the order of the file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, k, *row) for p, text in zip(part["path"], part["content"], strict=True) for k, row in enumerate(K.imports(p, text or ""))]
            yield pd.DataFrame(rows, columns=["path", "at", "alias", "name", "module", "beside", "package"])

    return files.where("language = 'python'").select("path", "content").mapInPandas(run, "path string, at int, alias string, name string, module string, beside string, package string")


def resolved_imports(found: DataFrame, paths: DataFrame) -> DataFrame:
    """path, alias, module_file (of an imported module), name_file and name (of an imported name) for aliases of local files.
    ``paths`` are the files that have functions."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    local = paths.select("path", F.regexp_replace("path", r"^\./", "").alias("clean"))
    parts = F.split(F.when(base(F.col("clean")) == "__init__.py", F.regexp_replace("clean", r"/?__init__\.py$", "")).otherwise(F.regexp_replace("clean", r"\.py$", "")), "/")
    ends = local.withColumn("parts", F.filter(parts, lambda x: x != "")).where(F.size("parts") > 0)
    ends = ends.select("clean", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n")).select("clean", F.expr("array_join(slice(parts, size(parts) - n + 1, n), '/')").alias("module"))
    first = ends.groupBy("module").agg(F.min("clean").alias("by_end"))
    last = local.groupBy(base(F.col("clean")).alias("file_name")).agg(F.max("path").alias("file"))
    clean = local.select("clean")
    d = found.withColumn("beside", F.regexp_replace("beside", r"^\./", "")).withColumn("package", F.regexp_replace("package", r"^\./", ""))
    d = d.join(clean.toDF("beside_hit"), F.col("beside") == F.col("beside_hit"), "left").join(clean.toDF("package_hit"), F.col("package") == F.col("package_hit"), "left").join(first, "module", "left")
    d = d.withColumn("file_name", base(F.coalesce("beside_hit", "package_hit", "by_end"))).where("file_name is not null").join(last, "file_name")
    whole, part = F.col("name").isNull(), F.col("name").isNotNull()
    latest = F.max_by(F.struct("file", "name"), F.when(part, F.col("at")))
    d = d.groupBy("path", "alias").agg(F.max_by("file", F.when(whole, F.col("at"))).alias("module_file"), latest.alias("_n"), F.max(part).alias("_any"), F.max(whole).alias("_mod"))
    return d.select("path", "alias", F.when(F.col("_mod"), F.col("module_file")).alias("module_file"), F.when(F.col("_any"), F.col("_n.file")).alias("name_file"), F.when(F.col("_any"), F.col("_n.name")).alias("imported"))


def _short(c: str = "qualified_name") -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def _class(c: str = "qualified_name") -> Column:
    return F.when(F.size(F.split(c, r"\.")) > 1, F.element_at(F.split(c, r"\."), -2))


def _key(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(kind), *parts)


def symbols(units: DataFrame) -> DataFrame:
    """file, key -> the last function of that short name (n:) or dotted name (q:) in the file."""
    keys = F.array(_key("n:", _short()), _key("q:", "qualified_name"))
    told = F.struct("fn_id", "qualified_name", F.length("code").alias("chars"))
    return units.select(F.col("path").alias("file"), F.explode(keys).alias("key"), "fn_ord", told.alias("hit")).groupBy("file", "key").agg(F.max_by("hit", "fn_ord").alias("hit"))


def variables(facts: DataFrame, names: DataFrame) -> DataFrame:
    """root (fn_id), var, file and class of the variables whose class can be told, by their last binding."""
    classes = facts.select(F.col("path").alias("file"), _key("c:", _class()).alias("key"), _class().alias("cls")).where("cls is not null").distinct()
    makers = facts.where("made is not null").groupBy(F.col("path").alias("file"), _key("f:", _short()).alias("key")).agg(F.max_by("made", "fn_ord").alias("cls"))
    origins = classes.unionByName(makers)
    b = facts.select("fn_id", "path", F.posexplode("binds").alias("at", "b")).select("fn_id", "path", "at", "b.*", F.coalesce("b.base", "b.name").alias("alias"))
    b = b.join(names, ["path", "alias"], "left")
    pair = lambda file, key: F.struct(F.col(file).alias("file"), key.alias("key"))
    made = F.array(pair("path", _key("c:", "name")), F.when(F.col("name_file").isNull(), pair("path", _key("f:", "name"))).otherwise(pair("name_file", _key("c:", "imported"))))
    wanted = F.when(F.col("form") == "made", made).when(F.col("form") == "made_by", F.array(pair("module_file", _key("f:", "name"))))
    looked = b.select("fn_id", "at", F.posexplode(wanted).alias("rank", "w")).select("fn_id", "at", "rank", "w.*").where("file is not null").join(origins, ["file", "key"])
    looked = looked.groupBy("fn_id", "at").agg(F.min_by(F.struct("file", "cls"), "rank").alias("hit"))
    told = F.when(F.col("form") == "told", F.struct(F.coalesce("name_file", "path").alias("file"), F.coalesce("imported", "name").alias("cls")))
    told = told.when(F.col("form") == "told_of", F.struct(F.coalesce("module_file", "path").alias("file"), F.col("name").alias("cls")))
    b = b.join(looked, ["fn_id", "at"], "left").withColumn("hit", F.coalesce(told, "hit"))
    # in order: a variable that is another's copy takes what that one has by then; the newest binding is first
    each = b.groupBy("fn_id").agg(F.array_sort(F.collect_list(F.struct("at", "var", "form", "name", "hit"))).alias("rows"))
    empty = F.expr("cast(array() as array<struct<var:string,hit:struct<file:string,cls:string>>>)")

    def step(have: Column, row: Column) -> Column:
        hit = F.when(row["form"] == "same", F.get(F.filter(have, lambda h: h["var"] == row["name"]), F.lit(0))["hit"]).otherwise(row["hit"])
        return F.when(hit.isNull(), have).otherwise(F.concat(F.array(F.struct(row["var"].alias("var"), hit.alias("hit"))), have))

    bound = each.select(F.col("fn_id").alias("root"), F.posexplode(F.aggregate("rows", empty, step)).alias("age", "v"))
    return bound.groupBy("root", F.col("v.var").alias("alias")).agg(F.min_by("v.hit", "age").alias("var"))


def _callees(frontier: DataFrame, facts: DataFrame, names: DataFrame, told: DataFrame, known: DataFrame) -> DataFrame:
    """root and its resolved calls (array of place, call, hit) for the functions of a level."""
    c = frontier.join(facts.select("fn_id", "calls"), "fn_id").select("root", "path", "class", "place", F.posexplode("calls").alias("call", "c"))
    c = c.select("root", "path", "class", "place", "call", "c.*", F.coalesce("c.base", "c.name").alias("alias"))
    c = c.join(names, ["path", "alias"], "left").join(told, ["root", "alias"], "left")
    pair = lambda file, key: F.struct(file.alias("file"), key.alias("key"))
    own, method = F.col("path"), lambda cls: _key("q:", cls, F.lit("."), "name")
    attr = F.when(F.col("base").isin("self", "cls") & F.col("class").isNotNull(), pair(own, method(F.col("class"))))
    attr = attr.when(F.col("var").isNotNull(), pair(F.col("var.file"), method(F.col("var.cls")))).otherwise(pair(F.col("module_file"), _key("n:", "name")))
    wanted = F.when(F.col("form") == "name", F.array(pair(own, _key("n:", "name")), pair(F.col("name_file"), _key("n:", "imported"))))
    wanted = wanted.when(F.col("form") == "attr", F.array(attr)).otherwise(F.array(pair(own, method(F.col("base"))), pair(F.col("name_file"), method(F.col("imported")))))
    c = c.select("root", "place", "call", F.posexplode(wanted).alias("rank", "w")).select("root", "place", "call", "rank", "w.*").where("file is not null")
    c = c.join(known, ["file", "key"]).groupBy("root", "place", "call").agg(F.min_by("hit", "rank").alias("hit"))
    return c.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "call", "hit"))).alias("calls"))


def call_snippets(files: DataFrame, units: DataFrame, params: Expansion, normalise: bool = True) -> DataFrame:
    """One EXP for each function that calls a local function which fits; none if switched off or at depth 0."""
    spark, depth = units.sparkSession, params.depth if params.enabled else 0
    scratch = Scratch(spark)
    units = scratch.cut(units.where("language = 'python'").dropDuplicates(["fn_id"]), "units") if depth else units.limit(0)
    facts = scratch.cut(function_facts(units), "facts") if depth else function_facts(units)
    names = resolved_imports(import_facts(files), units.select("path").distinct())
    names, told = (scratch.cut(names, "names"), scratch.cut(variables(facts, names), "variables")) if depth else (names, None)
    known = symbols(units)
    start = F.struct(F.length("code").cast("long").alias("chars"), F.array("fn_id").alias("seen"), F.array().alias("picked")).cast(STATE)
    roots = units.select(F.col("fn_id").alias("root"), start.alias("state"))
    frontier = units.select(F.col("fn_id").alias("root"), "path", _class().alias("class"), F.lit(0).alias("place"), "fn_id")
    heads = frontier.select("root", "path", "class")

    def step(s: Column, c: Column) -> Column:
        chars = s["chars"] + F.length(F.concat(F.lit("\n\n# expanded:"), c["hit"]["qualified_name"], F.lit("\n"))) + c["hit"]["chars"]
        taken = F.struct(chars.cast("long").alias("chars"), F.concat(s["seen"], F.array(c["hit"]["fn_id"])).alias("seen"), F.concat(s["picked"], F.array(F.struct(c["hit"]["fn_id"].alias("fn_id"), c["hit"]["qualified_name"].alias("qualified_name")))).alias("picked"))
        return F.when(F.array_contains(s["seen"], c["hit"]["fn_id"]) | (chars > params.max_chars), s).otherwise(taken)

    for level in range(depth):
        calls = _callees(frontier, facts, names, told, known)
        moved = roots.withColumn("had", F.size("state.picked")).join(calls, "root", "left")
        state = F.when(F.col("calls").isNull(), F.col("state")).otherwise(F.aggregate("calls", F.col("state"), step))
        moved = scratch.cut(moved.select("root", "had", state.alias("state")), f"level{level}")
        roots = moved.drop("had")
        added = moved.select("root", "had", F.posexplode("state.picked").alias("place", "p")).where("place >= had").select("root", "place", F.col("p.fn_id").alias("fn_id"))
        if added.isEmpty():
            break
        frontier = added.join(heads, "root").select("root", "path", "class", "place", "fn_id")
    helpers = roots.select("root", F.posexplode("state.picked").alias("place", "p")).join(units.select("fn_id", F.col("code").alias("helper")), F.col("p.fn_id") == F.col("fn_id"))
    added = helpers.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "p.qualified_name", "helper"))).alias("hs"))
    d = units.join(added, units["fn_id"] == added["root"])
    raw = F.concat("code", F.array_join(F.transform("hs", lambda h: F.concat(F.lit("\n\n# expanded:"), h["qualified_name"], F.lit("\n"), h["helper"])), ""))
    d = d.withColumn("text", _normalised(raw) if normalise else raw)
    key = F.concat_ws(":", F.lit("EXP"), "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "code_hash", F.array_join("hs.qualified_name", ","), F.lit(str(params.depth)), F.lit(str(params.max_chars)), "text")
    return d.select(F.lit("EXP").alias("kind"), "fn_id", "path", F.col("start_line").alias("fn_start"), F.col("end_line").alias("fn_end"), "start_line", "end_line", "text", F.sha2(key, 256).alias("snippet_hash")).select(*OUT)

"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, Config, Expansion, Thresholds, Windows
from ..functions import columns as C
from ..functions import sql
from ..operators import embed, expansion, incremental, knn, matches, overlap, snippets
from ..operators.index import VectorIndex
from ..operators.scratch import Scratch
from ..operators.snapshots import Store
from ..operators.upkeep import Clusters
from ..sources import tree
from ..sources.external import from_pairs
from ..sources.files import dealt, table_files
from ..streaming import arrivals
from .engine import least_cosine, positioned, scan_tables, touched

WINDOWS, K, THRESHOLDS = Windows(12, 6, 4), 25, Thresholds()


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark: SparkSession, sf: str, deal: Callable[[DataFrame], DataFrame] = dealt) -> DataFrame:
    return table_files(deal(_table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", "documents/")


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    pages = table_files(dealt(_table(spark, sf, "pages").select("page_id", "html")), "page_id", "html", "pages/")
    d = _files(spark, sf).unionByName(pages).where(F.col("content").rlike(C.INK))
    return d.select("path", "content_hash", "language", F.size(C.lines(F.col("content"))).alias("n_lines"))


def source_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a folder tree, read by globs: every fifth is named as code, a folder of each is left out, and so are names without an ending."""
    root = f"{Scratch(spark).root}/tree"
    local = root.removeprefix("file://")
    if "://" in local:
        raise RuntimeError("a source tree lies in a folder that all executors have mounted; spark.checkpoint.dir names none")
    ending = F.expr("case when doc_id % 5 = 0 then '.py' when doc_id % 11 = 0 then '' else '.txt' end")
    name = F.concat_ws("/", F.expr("'d' || doc_id % 7"), F.expr("'s' || doc_id % 3"), F.concat(F.col("doc_id").cast("string"), ending))
    d = dealt(_table(spark, sf, "documents").where("doc_id is not null").select(name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["name"].to_pylist(), b["content"].to_pylist(), strict=True):
                at = os.path.join(local, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(content)
            yield b.select(["name"])

    d.mapInArrow(written, "name string").write.format("noop").mode("overwrite").save()
    found = tree.read_tree(spark, [local], ["**/*.txt", "**/*.py"], ["**/s2/**"])
    return found.select(F.expr(f"substr(path, {len(local) + 2})").alias("path"), "content_hash", "language")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    w = snippets.window_snippets(snippets.text_units(_files(spark, sf)), WINDOWS, normalise=False)
    return w.select("path", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"), F.size(snippets.tokens("text")).alias("n_tokens"))


def lexical_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of benchmark items that share a token, through the tokens; counts, so that nothing is rounded."""
    b = _table(spark, sf, "benchmark").select("item_id", C.tokens(F.col("text")).alias("t"))
    sizes = b.select("item_id", F.size("t").alias("n"))
    each = b.select("item_id", F.explode("t").alias("token"))
    a, c = each.withColumnRenamed("item_id", "a_id"), each.withColumnRenamed("item_id", "b_id")
    both = a.join(c, "token").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    d = both.join(sizes.toDF("a_id", "a_n"), "a_id").join(sizes.toDF("b_id", "b_n"), "b_id")
    return d.select("a_id", "b_id", "shared", (F.col("a_n") + F.col("b_n") - F.col("shared")).cast("long").alias("joint")).where("5 * shared >= joint")


def stub_embedding(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "benchmark").select("item_id", F.posexplode(C.hash_vector(F.coalesce("text", F.lit("")))).alias("place", "x"))
    return d.select("item_id", "place", F.round("x", 6).alias("x"))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    return knn.knn(_embeddings(spark, sf), K).select("a_pos", "b_pos", F.round("score", 6).alias("score"))


def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    return knn.knn_cells(_embeddings(spark, sf), K, 64, 16).select("a_pos", "b_pos", F.round("score", 6).alias("score"))


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of every twentieth vector, by an index that was built of two thirds of the vectors and got the others later."""
    v, folder = _embeddings(spark, sf), f"{Scratch(spark).root}/index"
    VectorIndex(spark, folder).build(v.where("pos % 3 <> 0"), 64)
    VectorIndex(spark, folder).append(v.where("pos % 3 = 0"))
    found = VectorIndex(spark, folder).search(v.where("pos % 20 = 0"), 10, 8, exact=True)
    return found.select("a_pos", "b_pos", F.round("score", 6).alias("score"), "rank")


def _snippets(spark: SparkSession, files: DataFrame, again: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """The windows of files with pos, vec and text_hash, their sketches, and what gives the tokens of few of them.
    ``again``: the files, as few of them are best read."""
    d = Scratch(spark).cut(snippets.told_windows(files, WINDOWS), "windows", "zstd")
    d = positioned(d, overlap.sketcher(d, THRESHOLDS, snippets.digest_vectors))
    s = d.withColumn("text_hash", F.lower(F.hex("digest")))
    narrow = d.select("pos", "n", *(f"s{k}" for k in range(matches.LONGS)), "set", "first")

    def tokens(few: DataFrame) -> DataFrame:
        # few texts are cut again; what is told of a window by its hash tells its text
        asked = Scratch(spark).cut(d.select("pos", "path", "snippet_hash").join(few, "pos", "left_semi"), "asked")
        hint = F.broadcast if asked.count() <= 1_000_000 else lambda x: x
        some = (files if again is None else again).join(hint(asked.select("path").distinct()), "path", "left_semi")
        w = snippets.window_snippets(snippets.text_units(some), WINDOWS, normalise=False).join(hint(asked.select("snippet_hash").distinct()), "snippet_hash", "left_semi")
        return asked.join(w.dropDuplicates(["snippet_hash"]).select("snippet_hash", snippets.tokens("text").alias("tokens")), "snippet_hash").select("pos", "tokens")

    return s, narrow, tokens


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    s, narrow, tokens = _snippets(spark, _files(spark, sf), _files(spark, sf, lambda d: d))
    # equal texts have equal vectors, so k neighbours by distinct vector would do; ranks are kept by row as defined
    return matches.candidates(s, overlap.near(s, K, least_cosine(Config()), THRESHOLDS, narrow), THRESHOLDS, narrow, tokens)


SIDES = ("a_fn_id", "a_start_line", "a_end_line", "b_fn_id", "b_start_line", "b_end_line")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select(*SIDES, F.round("similarity", 6).alias("similarity"))


def span_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches.matches(_candidates(spark, sf)).select(*SIDES, F.round("similarity", 6).alias("similarity"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return matches.findings(matches.matches(_candidates(spark, sf), THRESHOLDS.lexical_min_ratio), THRESHOLDS)


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).select("fn_a", "fn_b", F.round("score", 6).alias("score"), "duplicated_lines", F.array_join("reasons", ",").alias("reasons"))


def evidence_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What stands behind each finding: matches, first and last covered line of either side, covered lines that the best match doesn't show."""
    found = Scratch(spark).cut(matches.matches(_candidates(spark, sf), THRESHOLDS.lexical_min_ratio), "matches")
    groups = matches.findings(found, THRESHOLDS)
    told = matches.evidence(found, groups).groupBy("fn_a", "fn_b").agg(F.count("*").alias("n_rows"), F.round(F.max("similarity"), 6).alias("most"))
    sides = [f"{c}_{x}" for x in "ab" for c in ("first", "last")]
    return groups.join(told, ["fn_a", "fn_b"]).select("fn_a", "fn_b", "n_evidence", "n_rows", "most", *sides, (F.col("before_a") + F.col("after_a") + F.col("best.a_end") - F.col("best.a_start") + 1).alias("lines_a"), (F.col("before_b") + F.col("after_b") + F.col("best.b_end") - F.col("best.b_start") + 1).alias("lines_b"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    d = Scratch(spark).cut(_findings(spark, sf).select("fn_a", "fn_b"), "findings")
    return matches.clusters(d, 2).select("fn_a", "fn_b", "cluster", "cluster_size")


def arrivals_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream, a second apart by their ids: those that equal windows hold together."""
    d = spark.readStream.schema(_table(spark, sf, "documents").schema).parquet(f"{sf}/document[s].parquet")  # a stream of files takes a pattern, not one file
    named = d.select(F.concat(F.lit("documents/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id"), "text", F.timestamp_seconds(F.coalesce("doc_id", F.lit(0))).alias("at"))
    root = Scratch(spark).root
    arrivals.watch(named, "id", "text", "at", f"{root}/links", f"{root}/state", WINDOWS, timedelta(days=36500)).awaitTermination()
    return arrivals.clusters(spark.read.schema(arrivals.LINK).parquet(f"{root}/links"))


def clusters_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """The same clusters, kept through changes: a third of the findings comes later, and a node that held every fifth together goes."""
    d = Scratch(spark).cut(_findings(spark, sf).select("fn_a", "fn_b"), "findings")
    edges, part = d.toDF("src", "dst"), F.pmod(F.xxhash64("src", "dst"), F.lit(15))
    hub = edges.where(part % 5 == 1).select("src", F.lit("").alias("dst"))
    kept = Clusters(spark, f"{Scratch(spark).root}/clusters")
    kept.update(edges.where(part % 3 != 0).unionByName(hub), hub.limit(0))
    kept.update(edges.where(part % 3 == 0), hub.where(part % 2 == 1))
    return matches.clusters(d, 2, kept).select("fn_a", "fn_b", "cluster", "cluster_size")


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the documents labelled of low quality, which stand for changed files."""
    return _table(spark, sf, "labels").where("quality = 0").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path")).distinct()


def diff_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with a side among the changed files."""
    return touched(_findings(spark, sf), _changed(spark, sf)).select("fn_a", "fn_b")


def diff_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same by what an earlier scan has left: of the changed files every third is new since then and the others had a line more at
    their top, and the items of the benchmark were files too, which are gone. Pairs by tokens
    are looked for among all; of the vectors that ask, those that the state has answers for are held against new ones only."""
    now, changed, least = _files(spark, sf), _changed(spark, sf), least_cosine(Config())
    was = now.join(changed.withColumn("changed", F.lit(True)), "path", "left").where(F.expr("changed is null or crc32(cast(path as binary)) % 3 <> 0"))
    was = was.withColumn("content", F.when(F.col("changed"), F.concat(F.lit("a first line\n"), "content")).otherwise(F.col("content"))).drop("changed")
    was = was.unionByName(table_files(_table(spark, sf, "benchmark").select("item_id", "text"), "item_id", "text", "benchmark/"))
    store = Store(spark, f"{Scratch(spark).root}/state")
    for files in (was, now):
        s, narrow, tokens = _snippets(spark, files)
        near = overlap.near(s, K, least, THRESHOLDS, narrow, incremental.through(store, s, K, least, {"k": K}))
    found = matches.matches(matches.candidates(s, incremental.within(near, s, changed), THRESHOLDS, narrow, tokens), THRESHOLDS.lexical_min_ratio)
    return touched(matches.findings(found, THRESHOLDS), changed).select("fn_a", "fn_b", F.round("score", 6).alias("score"), "duplicated_lines")


def snippet_union(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three tables in one bag, counted by table and lines."""
    tables = (("documents", F.col("doc_id"), "text"), ("pages", F.col("page_id"), "html"), ("conversations", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"))
    out = None
    for name, key, text in tables:
        f = table_files(dealt(_table(spark, sf, name).select(key.alias("_key"), text)), "_key", text, f"{name}/")
        w = snippets.window_snippets(snippets.text_units(f), WINDOWS, normalise=False).select(F.lit(name).alias("origin"), (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
        out = w if out is None else out.unionByName(w)
    return out.groupBy("origin", "n_lines").agg(F.count("*").alias("n"))


def cache_hits_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents that a cache has from an earlier run over benchmark, conversations and the English documents."""
    of = lambda name: _table(spark, sf, name).select(F.coalesce("text", F.lit("")).alias("text"))
    english = _table(spark, sf, "documents").where("lang = 'en'").select(F.coalesce("text", F.lit("")).alias("text"))
    stub, folder = PRESETS["stub"], f"{Scratch(spark).root}/cache"
    embed.embed(of("benchmark").unionByName(of("conversations")).unionByName(english), stub, folder)
    found, _ = embed.embed(_table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("text")), stub, folder)
    return found.groupBy("source").agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))


def external_duplications(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of one region as if a tool had reported them as duplicates."""
    n = _table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    side = lambda x: F.struct(F.col(f"{x}.n_name").alias("path"), F.col(f"{x}.n_regionkey").cast("string").alias("start"), F.col(f"{x}.n_nationkey").cast("string").alias("end"), F.lit("").alias("code"), F.col(f"{x}.n_name").alias("name")).alias(x)
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(side("a"), side("b"))
    return from_pairs(pairs).select("fn_a", "fn_b", "score", "duplicated_lines")


def scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What a scan counts while it writes."""
    stats = scan_tables(spark, _files(spark, sf), Config(windows=WINDOWS, embedder=PRESETS["stub"]), normalise=False).stats
    names = ("file_count", "snippet_count", "finding_count")
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


#: a Python file for a nation: a function with a docstring, one that calls it, and a method; {r} is the region
CODE = """import os

def total_{r}(xs):
    "Sum of xs."
    acc = {r}  # where it starts
    for x in xs:
        acc += x
    return acc

def fill_{r}(ys):
    n = total_{r}(ys)
    out = []
    out.append(n)
    return out

class Box:
    def get(self):
        return {r}
"""
CODE_CONFIG = Config(windows=WINDOWS, expansion=Expansion(enabled=True), embedder=PRESETS["stub"])


def _code(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation")
    text = F.replace(F.lit(CODE), F.lit("{r}"), F.col("n_regionkey").cast("string"))
    return n.select(F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), text.alias("content"), F.sha2(text, 256).alias("content_hash"), F.lit("python").alias("language"))


def code_functions(spark: SparkSession, sf: str) -> DataFrame:
    return snippets.function_units(_code(spark, sf)).select("path", "qualified_name", "start_line", "end_line", "fn_ord", "code_hash")


def code_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, their windows and call expansions, by their normalised text."""
    files = _code(spark, sf)
    units = snippets.function_units(files)
    bag = snippets.function_snippets(units).unionByName(snippets.window_snippets(units, WINDOWS)).unionByName(expansion.call_snippets(files, units, CODE_CONFIG.expansion))
    return bag.select("kind", "fn_id", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


def code_findings(spark: SparkSession, sf: str) -> DataFrame:
    """A whole scan of code: reasons, covered lines, the best match and how many matches stand behind it."""
    found = scan_tables(spark, _code(spark, sf), CODE_CONFIG).findings
    best = [F.col(f"best.{c}").alias(f"best_{c}") for c in ("a_kind", "b_kind", "a_start", "a_end", "b_start", "b_end")]
    return found.select("fn_a", "fn_b", F.round("score", 6).alias("score"), "duplicated_lines", F.array_join("reasons", ",").alias("reasons"), "n_evidence", *best)


SNIPPETS_SQL = """
WITH f AS (SELECT path, t.*, concat_ws(':', path, t.qualified_name, t.start_line, t.end_line) AS fn_id FROM {files}, LATERAL source_functions(content) t)
SELECT 'FUNC' AS kind, fn_id, start_line, end_line, sha2(normalised(code), 256) AS text_hash FROM f
UNION ALL SELECT 'WIN', fn_id, start_line + w.at, start_line + w.rel - 1, sha2(normalised(w.raw), 256) FROM f, LATERAL line_windows(code, 12, 6, 4) w
UNION ALL SELECT 'EXP', caller.fn_id, caller.start_line, caller.end_line, sha2(normalised(concat(caller.code, '\n\n# expanded:', called.qualified_name, '\n', called.code)), 256)
  FROM (SELECT f.*, c.name FROM f, LATERAL source_calls(code) c WHERE c.form = 'name') caller JOIN f called ON called.path = caller.path AND called.qualified_name = caller.name
"""


def sql_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The snippets of code_snippets by SQL alone, with the table functions of this package."""
    sql.register(spark)
    return spark.sql(SNIPPETS_SQL, files=_code(spark, sf))


def sql_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How much of its words each window of a document shares with the one before it, by SQL alone."""
    sql.register(spark)
    return spark.sql(
        """WITH w AS (SELECT path, t.at, tokens(t.raw) AS words FROM {files}, LATERAL line_windows(content, 12, 6, 4) t)
        SELECT path, at AS line, size(words) AS n_words, round(jaccard(words, lag(words) OVER (PARTITION BY path ORDER BY at)), 6) AS lexical FROM w""",
        files=_files(spark, sf),
    )


#: projects of four files for each supplier {k}: what is called is in the same file, in modules imported whole or by name, in a package
#: elsewhere, or a method of an instance that is made, copied, annotated or returned. By file: lines at its top, and its functions and classes.
PROJECT = {
    "c{k}/main.py": (
        ["import tools{k}", "import lib{k}.deep{k} as deep", "import shapes{k} as sh", "from shapes{k} import Box, Box as Crate", "from tools{k} import mean as average, nothing"],
        {
            "here": "def here(x):\n    return mid(x) + {k}",
            "mid": "def mid(x):\n    return low(x)",
            "low": "def low(x):\n    return x * {k}",
            "by_name": "def by_name(x):\n    return average(x)",
            "by_module": "def by_module(x):\n    return tools{k}.mean(x) + deep.dig(x)",
            "by_copy": "def by_copy(x):\n    a = Box()\n    b = a\n    return b.area(x)",
            "by_annotation": "def by_annotation(x):\n    a: Crate = x\n    return a.area(1)",
            "by_module_annotation": "def by_module_annotation(x):\n    a: sh.Box = x\n    return a.area(2)",
            "by_constructor": "def by_constructor(x):\n    return Box().area(x)",
            "by_factory": "def by_factory(x):\n    a = tools{k}.make()\n    return a.run()",
            "local": "def local():\n    return Own()",
            "by_local": "def by_local(x):\n    a = local()\n    return a.go(x)",
            "alone": "def alone(x):\n    return print(x) or nothing(x) or nowhere.at(x)",
            "Own.go": "class Own:\n    def go(self, x):\n        return x - {k}",
        },
    ),
    "c{k}/tools{k}.py": ([], {"mean": "def mean(x):\n    return sum(x) / {k}", "make": "def make():\n    return Tool()", "Tool.run": "class Tool:\n    def run(self):\n        return {k}"}),
    "c{k}/shapes{k}.py": ([], {"Box.area": "class Box:\n    def area(self, x):\n        return x + {k}"}),
    "lib{k}/deep{k}/__init__.py": ([], {"dig": "def dig(x):\n    return x or {k}"}),
}
#: what is found for each function at depth 2, in order; of files of one name, such as those of packages, the last path counts
CALLED = {"here": "mid low", "mid": "low", "by_name": "mean", "by_module": "mean dig", "by_copy": "Box.area", "by_annotation": "Box.area", "by_module_annotation": "Box.area", "by_constructor": "Box.area", "by_factory": "make Tool.run", "by_local": "local Own.go"}


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    put = lambda x: F.replace(F.lit(x), F.lit("{k}"), F.col("s_suppkey").cast("string"))
    texts = {path: "\n\n".join(["\n".join(top), *parts.values()] if top else parts.values()) + "\n" for path, (top, parts) in PROJECT.items()}
    files = F.array(*[F.struct(put(path).alias("path"), put(text).alias("content")) for path, text in texts.items()])
    # keys are few bytes and much work, so they are dealt out before files are made of them
    d = dealt(_table(spark, sf, "supplier").select("s_suppkey")).select("s_suppkey", F.explode(files).alias("f")).select("f.*")
    return d.withColumn("content_hash", F.sha2("content", 256)).withColumn("language", F.lit("python"))


def code_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with the code of what they call, two levels deep, through imports, methods, instances and factories."""
    files = _projects(spark, sf)
    found = expansion.call_snippets(files, snippets.function_units(files), Expansion(enabled=True, depth=2), normalise=False)
    helpers = F.array_join(F.regexp_extract_all("text", F.lit("# expanded:([^\n]*)"), F.lit(1)), ",")
    return found.select("fn_id", "start_line", "end_line", helpers.alias("helpers"), F.sha2("text", 256).alias("text_hash"))


def _called_sql() -> str:
    """The functions of CALLED with their texts put together as SQL, by the lines that PROJECT gives them."""
    said = lambda text, k: "replace('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + f"', '{{k}}', {k}::VARCHAR)"
    own = {name: code.partition("\n")[2] if "." in name else code for _, parts in PROJECT.values() for name, code in parts.items()}
    top, parts = PROJECT["c{k}/main.py"]
    rows, line = [], len(top) + 2
    for name, code in parts.items():
        last = line + code.count("\n")
        if name in CALLED:
            more = [f" || chr(10) || chr(10) || '# expanded:{h}' || chr(10) || {said(own[h], 'z' if h == 'dig' else 'k')}" for h in CALLED[name].split()]
            rows.append(f"SELECT 'c' || k || '/main.py:{name}:{line}:{last}' AS fn_id, {line}::INTEGER AS start_line, {last}::INTEGER AS end_line, '{CALLED[name].replace(' ', ',')}' AS helpers, sha256({said(code, 'k')}{''.join(more)}) AS text_hash FROM s, l")
        line = last + 2
    return "WITH s AS (SELECT s_suppkey AS k FROM supplier), l AS (SELECT arg_max(k, 'lib' || k || '/deep' || k || '/__init__.py') AS z FROM s) " + " UNION ALL ".join(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (fingerprints, source_tree, windows, lexical_pairs, stub_embedding, knn_exact, knn_cells, index_search, candidates, span_matches, findings, evidence_lines, clusters, clusters_upkeep, arrivals_clusters, diff_scope, diff_incremental, snippet_union, cache_hits_misses, external_duplications, scan_stats, code_functions, code_snippets, code_findings, code_calls, sql_snippets, sql_overlap)
    return {f.__name__: f for f in own}


INK = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _text(col: str) -> str:
    return f"regexp_replace(coalesce({col}, ''), '\\r\\n?', chr(10), 'g')"


def _lines(col: str) -> str:
    parts = f"string_split_regex({col}, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"(SELECT CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END FROM (SELECT {parts} AS p))"


def _windows(table: str, key: str, col: str) -> str:
    return f"""(SELECT path, w0 + 1 AS start_line, w0 + len(cut) AS end_line, array_to_string(cut, chr(10)) AS text FROM (
      SELECT path, w0, l[w0 + 1:w0 + 12] AS cut FROM (
        SELECT path, l, unnest(range(0, len(l), 6)) AS w0 FROM (
          SELECT '{table}/' || {key} AS path, {_lines("c")} AS l FROM (SELECT *, {_text(col)} AS c FROM {table}) WHERE regexp_matches(c, '{INK}'))))
      WHERE len(list_filter(cut, lambda x: regexp_matches(x, '{INK}'))) >= 4)"""


_TOKENS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+')))"

_CHAIN = f"""
win AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path, start_line, end_line) AS pos FROM {_windows("documents", "doc_id", "text")}),
units AS (SELECT path, max(n) AS n FROM (SELECT 'documents/' || doc_id AS path, len({_lines("c")}) AS n FROM (SELECT doc_id, {_text("text")} AS c FROM documents)) GROUP BY path),
s0 AS (SELECT pos, path, start_line, end_line, text, path || ':' || split_part(path, '/', -1) || ':1:' || n AS fn_id FROM win JOIN units USING (path)),
raw AS (SELECT pos, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(text), 2 * i + 1, 2))::INT / 255.0::DOUBLE) AS v FROM s0),
vec AS MATERIALIZED (SELECT pos, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM raw),
sn AS MATERIALIZED (SELECT pos, path, start_line, end_line, fn_id, {_TOKENS.format("text")} AS t, sha256(text) AS th FROM s0),
sc AS (SELECT a.pos AS ap, b.pos AS bp, round(list_inner_product(a.v, b.v), 9) AS score FROM vec a, vec b),
nn AS (SELECT ap, bp, score FROM sc WHERE score >= 0.857 QUALIFY row_number() OVER (PARTITION BY ap ORDER BY score DESC, bp) <= 25),
cand AS (SELECT a.pos AS a_pos, b.pos AS b_pos, a.fn_id AS a_fn_id, a.path AS a_path, a.start_line AS a_start_line, a.end_line AS a_end_line,
                b.fn_id AS b_fn_id, b.path AS b_path, b.start_line AS b_start_line, b.end_line AS b_end_line, 0.7 * score + 0.3 * lex AS similarity
  FROM (SELECT nn.*, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS lex
        FROM nn JOIN sn a ON ap = a.pos JOIN sn b ON bp = b.pos WHERE ap <> bp) x
  JOIN sn a ON ap = a.pos JOIN sn b ON bp = b.pos WHERE lex >= 0.5 AND 0.7 * score + 0.3 * lex >= 0.9),
mat AS (SELECT * FROM (
    SELECT CASE WHEN w THEN a_fn_id ELSE b_fn_id END AS a_fn_id, CASE WHEN w THEN a_start_line ELSE b_start_line END AS a_start_line, CASE WHEN w THEN a_end_line ELSE b_end_line END AS a_end_line,
           CASE WHEN w THEN b_fn_id ELSE a_fn_id END AS b_fn_id, CASE WHEN w THEN b_start_line ELSE a_start_line END AS b_start_line, CASE WHEN w THEN b_end_line ELSE a_end_line END AS b_end_line, similarity
    FROM (SELECT *, (a_fn_id, a_start_line, a_end_line, a_pos) <= (b_fn_id, b_start_line, b_end_line, b_pos) AS w FROM cand
          WHERE CASE WHEN a_fn_id = b_fn_id THEN least(a_end_line, b_end_line) < greatest(a_start_line, b_start_line) ELSE a_path <> b_path END))
  QUALIFY row_number() OVER (PARTITION BY a_fn_id, a_start_line, a_end_line, b_fn_id, b_start_line, b_end_line ORDER BY similarity DESC) = 1),
ln AS (SELECT DISTINCT a_fn_id AS fn_a, b_fn_id AS fn_b, side, unnest(range(s, e + 1)) AS line FROM (
    SELECT a_fn_id, b_fn_id, 'a' AS side, a_start_line AS s, a_end_line AS e FROM mat UNION ALL SELECT a_fn_id, b_fn_id, 'b', b_start_line, b_end_line FROM mat)),
cov AS (SELECT fn_a, fn_b, min(n)::INTEGER AS duplicated_lines FROM (SELECT fn_a, fn_b, side, count(*) AS n FROM ln GROUP BY ALL) GROUP BY ALL),
fin AS (SELECT a_fn_id AS fn_a, b_fn_id AS fn_b, max(similarity) AS score FROM mat GROUP BY ALL)
"""

_SIDES = "a_fn_id, a_start_line::INTEGER AS a_start_line, a_end_line::INTEGER AS a_end_line, b_fn_id, b_start_line::INTEGER AS b_start_line, b_end_line::INTEGER AS b_end_line"


_TOTAL = "'def total_' || r || '(xs):' || chr(10) || {doc} || chr(10) || '    acc = ' || r || {note} || chr(10) || '    for x in xs:' || chr(10) || '        acc += x' || chr(10) || '    return acc'"
_FILL = "'def fill_' || r || '(ys):' || chr(10) || '    n = total_' || r || '(ys)' || chr(10) || '    out = []' || chr(10) || '    out.append(n)' || chr(10) || '    return out'"
_GET = "'    def get(self):' || chr(10) || '        return ' || r"
_SAID = _TOTAL.format(doc="""'    "Sum of xs."'""", note="'  # where it starts'")
_NORMAL = _TOTAL.format(doc="'    pass'", note="''")
_CODE = f"""
nat AS (SELECT 'src/n' || n_nationkey || '.py' AS path, n_regionkey AS r FROM nation),
fns AS (SELECT path, 'total_' || r AS name, 3 AS s, 8 AS e, 0 AS ord, {_SAID} AS code, {_NORMAL} AS txt, NULL AS helper FROM nat
  UNION ALL SELECT path, 'fill_' || r, 10, 14, 1, {_FILL}, {_FILL}, {_NORMAL} FROM nat
  UNION ALL SELECT path, 'Box.get', 17, 18, 2, {_GET}, {_GET}, NULL FROM nat),
ids AS (SELECT *, path || ':' || name || ':' || s || ':' || e AS fn_id FROM fns),
bag AS (SELECT 'FUNC' AS kind, path, fn_id, s, e, txt FROM ids
  UNION ALL SELECT 'WIN', path, fn_id, s, e, txt FROM ids WHERE e - s >= 3
  UNION ALL SELECT 'EXP', path, fn_id, s, e, txt || chr(10) || chr(10) || helper FROM ids WHERE helper IS NOT NULL)"""
_CODE_CHAIN = f"""{_CODE},
sn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY kind, path, fn_id, s, e) AS pos, {_TOKENS.format("txt")} AS t FROM bag),
raw AS (SELECT pos, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(txt), 2 * i + 1, 2))::INT / 255.0::DOUBLE) AS v FROM sn),
vec AS MATERIALIZED (SELECT pos, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM raw),
sc AS (SELECT a.pos AS ap, b.pos AS bp, round(list_inner_product(a.v, b.v), 9) AS score FROM vec a, vec b),
nn AS (SELECT ap, bp, score FROM sc QUALIFY row_number() OVER (PARTITION BY ap ORDER BY score DESC, bp) <= 25),
lx AS (SELECT nn.*, len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS lex FROM nn JOIN sn a ON ap = a.pos JOIN sn b ON bp = b.pos WHERE ap <> bp),
cand AS (SELECT least(ap, bp) AS lo, greatest(ap, bp) AS hi, ap, bp, 0.7 * score + 0.3 * lex AS sim, b.kind AS bk FROM lx JOIN sn b ON bp = b.pos WHERE lex >= 0.5 AND sim >= CASE bk WHEN 'FUNC' THEN 0.92 ELSE 0.9 END),
two AS (SELECT sim, a.pos AS a_pos, b.pos AS b_pos, a.fn_id AS fa, b.fn_id AS fb, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e, a.kind AS ak, b.kind AS bk
  FROM (SELECT sim, CASE WHEN (x.fn_id, x.s, x.e, ap) <= (y.fn_id, y.s, y.e, bp) THEN ap ELSE bp END AS lo, CASE WHEN (x.fn_id, x.s, x.e, ap) <= (y.fn_id, y.s, y.e, bp) THEN bp ELSE ap END AS hi
        FROM cand JOIN sn x ON ap = x.pos JOIN sn y ON bp = y.pos
        WHERE CASE WHEN x.path = y.path THEN least(x.e, y.e) < greatest(x.s, y.s) ELSE true END) JOIN sn a ON lo = a.pos JOIN sn b ON hi = b.pos),
kr AS (SELECT *, CASE WHEN ak <> bk THEN 0 WHEN ak = 'FUNC' THEN 3 WHEN ak = 'EXP' THEN 2 ELSE 1 END AS rk, least(a_e - a_s, b_e - b_s) AS len FROM two),
mat AS (SELECT * FROM kr QUALIFY row_number() OVER (PARTITION BY fa, a_s, a_e, fb, b_s, b_e ORDER BY sim DESC, rk DESC, a_pos, b_pos) = 1),
best AS (SELECT * FROM mat QUALIFY row_number() OVER (PARTITION BY fa, fb ORDER BY rk DESC, len DESC, sim DESC, a_pos, b_pos) = 1),
grp AS (SELECT fa, fb, max(sim) AS score, count(*) AS n, max(CASE WHEN 'FUNC' IN (ak, bk) THEN sim END) AS f, max(CASE WHEN 'EXP' IN (ak, bk) THEN sim END) AS x, count_if('WIN' IN (ak, bk)) AS w,
    least(max(a_e) - min(a_s), max(b_e) - min(b_s)) + 1 AS lines FROM mat GROUP BY fa, fb)"""

_CLUSTERS = f"""WITH RECURSIVE {_CHAIN}, e AS MATERIALIZED (SELECT fn_a AS x, fn_b AS y FROM fin UNION SELECT fn_b, fn_a FROM fin),
    r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
    c AS (SELECT node, min(root) AS cluster FROM r GROUP BY node)
    SELECT * FROM (SELECT fn_a, fn_b, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM fin JOIN c ON fn_a = node) WHERE cluster_size >= 2"""

#: Both searches are exact.
_KNN = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
    s AS (SELECT a.vec_id AS a_pos, b.vec_id AS b_pos, round(list_inner_product(a.e, b.e), 9) AS score FROM n a, n b)
    SELECT a_pos, b_pos, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY a_pos ORDER BY score DESC, b_pos) <= 25"""


def oracle_sql() -> dict[str, str]:
    conv = "conv_id || '-' || turn"
    return {
        "fingerprints": " UNION ALL ".join(
            f"SELECT '{t}/' || {k} AS path, sha256(c) AS content_hash, 'text' AS language, len({_lines('c')})::INTEGER AS n_lines FROM (SELECT *, {_text(x)} AS c FROM {t}) WHERE regexp_matches(c, '{INK}')" for t, k, x in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))
        ),
        "source_tree": f"""SELECT 'd' || doc_id % 7 || '/s' || doc_id % 3 || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.py' ELSE '.txt' END AS path, sha256(c) AS content_hash,
            CASE WHEN doc_id % 5 = 0 THEN 'python' ELSE 'text' END AS language FROM (SELECT doc_id, {_text('text')} AS c FROM documents) WHERE doc_id % 3 <> 2 AND (doc_id % 5 = 0 OR doc_id % 11 <> 0)""",
        "windows": f"SELECT path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, sha256(text) AS text_hash, len({_TOKENS.format('text')})::INTEGER AS n_tokens FROM {_windows('documents', 'doc_id', 'text')}",
        "lexical_pairs": f"""WITH b AS (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark)
            SELECT * FROM (SELECT a.item_id AS a_id, b.item_id AS b_id, len(list_intersect(a.t, b.t))::BIGINT AS shared, (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::BIGINT AS joint
            FROM b a JOIN b ON a.item_id < b.item_id) WHERE 5 * shared >= joint AND shared > 0""",
        "stub_embedding": """WITH r AS (SELECT item_id, list_transform(range(0, 16), lambda i: ('0x' || substr(sha256(coalesce(text, '')), 2 * i + 1, 2))::INT / 255.0::DOUBLE) AS v FROM benchmark)
            SELECT item_id, place::INTEGER AS place, round(v[place + 1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS x FROM (SELECT *, unnest(range(0, 16)) AS place FROM r)""",
        "knn_exact": _KNN,
        "knn_cells": _KNN,
        "index_search": _KNN.split("SELECT a_pos")[0] + """SELECT a_pos, b_pos, round(score, 6) AS score, rank::INTEGER AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY a_pos ORDER BY score DESC, b_pos) AS rank FROM s WHERE a_pos % 20 = 0) WHERE rank <= 10""",
        "candidates": f"WITH {_CHAIN} SELECT {_SIDES}, round(similarity, 6) AS similarity FROM cand",
        "span_matches": f"WITH {_CHAIN} SELECT {_SIDES}, round(similarity, 6) AS similarity FROM mat",
        "findings": f"WITH {_CHAIN} SELECT fn_a, fn_b, round(score, 6) AS score, duplicated_lines, 'window' AS reasons FROM fin JOIN cov USING (fn_a, fn_b)",
        "evidence_lines": f"""WITH {_CHAIN}, one AS (SELECT fn_a, fn_b, count_if(side = 'a')::INTEGER AS lines_a, count_if(side = 'b')::INTEGER AS lines_b FROM ln GROUP BY ALL)
            SELECT fn_a, fn_b, count(*)::INTEGER AS n_evidence, count(*) AS n_rows, round(max(similarity), 6) AS most, min(a_start_line)::INTEGER AS first_a, max(a_end_line)::INTEGER AS last_a,
            min(b_start_line)::INTEGER AS first_b, max(b_end_line)::INTEGER AS last_b, any_value(lines_a) AS lines_a, any_value(lines_b) AS lines_b FROM mat JOIN one ON a_fn_id = fn_a AND b_fn_id = fn_b GROUP BY fn_a, fn_b""",
        "clusters": _CLUSTERS,
        "clusters_upkeep": _CLUSTERS,
        "arrivals_clusters": f"""WITH RECURSIVE w AS (SELECT DISTINCT path, text FROM {_windows('documents', 'doc_id', 'text')}),
            e AS MATERIALIZED (SELECT DISTINCT path AS x, least_path AS y FROM (SELECT path, min(path) OVER (PARTITION BY text) AS least_path FROM w) WHERE path <> least_path),
            b AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
            r AS (SELECT x AS node, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node)
            SELECT node, min(root) AS component FROM r GROUP BY node""",
        "diff_scope": f"""WITH {_CHAIN}, p AS (SELECT 'documents/' || doc_id || ':' AS p FROM labels WHERE quality = 0)
            SELECT fn_a, fn_b FROM fin WHERE EXISTS (FROM p WHERE starts_with(fn_a, p.p) OR starts_with(fn_b, p.p))""",
        "diff_incremental": f"""WITH {_CHAIN}, p AS (SELECT 'documents/' || doc_id || ':' AS p FROM labels WHERE quality = 0)
            SELECT fn_a, fn_b, round(score, 6) AS score, duplicated_lines FROM fin JOIN cov USING (fn_a, fn_b) WHERE EXISTS (FROM p WHERE starts_with(fn_a, p.p) OR starts_with(fn_b, p.p))""",
        "snippet_union": " UNION ALL ".join(f"SELECT '{t}' AS origin, (end_line - start_line + 1)::INTEGER AS n_lines, count(*) AS n FROM {_windows(t, k, x)} GROUP BY ALL" for t, k, x in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", conv, "text"))),
        "cache_hits_misses": """WITH o AS (SELECT DISTINCT coalesce(text, '') AS t FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM documents WHERE lang = 'en'))
            SELECT source, count(o.t) AS hits, count(*) - count(o.t) AS misses FROM documents LEFT JOIN o ON coalesce(text, '') = o.t GROUP BY source""",
        "external_duplications": """SELECT concat_ws(':', a.n_name, a.n_name, a.n_regionkey, a.n_nationkey) AS fn_a, concat_ws(':', b.n_name, b.n_name, b.n_regionkey, b.n_nationkey) AS fn_b, 1.0::DOUBLE AS score,
            (least(a.n_nationkey - a.n_regionkey, b.n_nationkey - b.n_regionkey) + 1)::INTEGER AS duplicated_lines FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
        "code_functions": f"WITH {_CODE} SELECT path, name AS qualified_name, s::INTEGER AS start_line, e::INTEGER AS end_line, ord::INTEGER AS fn_ord, sha256(code) AS code_hash FROM ids",
        "code_snippets": f"WITH {_CODE} SELECT kind, fn_id, s::INTEGER AS start_line, e::INTEGER AS end_line, sha256(txt) AS text_hash FROM bag",
        "sql_snippets": f"WITH {_CODE} SELECT kind, fn_id, s::INTEGER AS start_line, e::INTEGER AS end_line, sha256(txt) AS text_hash FROM bag",
        "sql_overlap": f"""WITH w AS (SELECT path, (start_line - 1)::INTEGER AS line, {_TOKENS.format('text')} AS t FROM {_windows('documents', 'doc_id', 'text')}),
            p AS (SELECT *, lag(t) OVER (PARTITION BY path ORDER BY line) AS q FROM w)
            SELECT path, line, len(t)::INTEGER AS n_words, CASE WHEN q IS NULL THEN NULL WHEN len(t) = 0 OR len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(t, q))::DOUBLE / (len(t) + len(q) - len(list_intersect(t, q))), 6) END AS lexical FROM p""",
        "code_findings": f"""WITH {_CODE_CHAIN} SELECT fa AS fn_a, fb AS fn_b, round(score, 6) AS score, lines::INTEGER AS duplicated_lines,
            concat_ws(',', CASE WHEN f >= 0.92 THEN 'func' END, CASE WHEN x >= 0.9 THEN 'exp' END, CASE WHEN w > 0 THEN 'window' END) AS reasons, n::INTEGER AS n_evidence,
            ak AS best_a_kind, bk AS best_b_kind, a_s::INTEGER AS best_a_start, a_e::INTEGER AS best_a_end, b_s::INTEGER AS best_b_start, b_e::INTEGER AS best_b_end
            FROM grp JOIN best USING (fa, fb) WHERE f >= 0.92 OR x >= 0.9 OR w > 0""",
        "code_calls": _called_sql(),
        "scan_stats": f"WITH {_CHAIN} SELECT (SELECT count(*) FROM documents) AS file_count, (SELECT count(*) FROM win) AS snippet_count, (SELECT count(*) FROM fin) AS finding_count",
    }

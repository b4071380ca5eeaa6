"""Benchmark decontamination by template canonicalisation.

A text's tokens are numbers (of any script) and words. In its template a number, a name (words with a capital letter with
nothing but blanks or line feeds between them) and a unit (a known unit after a number) are typed placeholders, one each however many
words a name has; other words are lower-cased. Windows of ``window`` tokens are hashed as template and, of single
words, as literal lower-cased text, and joined with the windows of all benchmark items by hash. An item is
found as a ``copy`` if the literal windows of at least ``share`` percent of its windows are in the document, or RUN words
in a row, or, of shifts near each other, that share of its windows of SHORT words, which small edits leave; or as
``reparameterised`` if template windows are and the slots agree: each value of the item stands for one value of the
document wherever it occurs in one occurrence. Occurrences are judged each by itself: hits of one shift against the item,
of shifts near each other, or of the whole document; template_hits and slots_agree are those of the best. A template window needs ``literal`` words that are no placeholder; the share is taken of
the windows that have them. Of items with fewer than FEW such windows it is taken of all, and their whole template is
looked for besides, if it has ``literal`` words; what has fewer can be a ``copy`` only.

Wording that items share, such as one instruction before many questions, is no sign of any of them. A window that more than
COMMON different items have (different in their words, or for template windows in their templates) is common: it isn't joined,
and shares are taken of the windows that are an item's own. An item with fewer than FEW of these, and common ones besides, is a
``copy`` only where all of its text stands in a row, and by its template only where all of that does; it is looked for from its rarest
window. So a document that holds the shared words alone is joined with no item. Copies of one item are one item here.

Built-in functions only. The benchmark side is broadcast if its windows take at most ``broadcast_bytes``, else both
sides are shuffled by hash. Windows are joined as they are made, within the stage that reads the text; what is shuffled
are hits. Null and empty texts have no window, very long ones all of theirs. Items shorter than a window are one window of
their own length, for which a pass of its own is made (at most ``window`` - 1 of them, and none if there are no such
items); items without a token are in nothing. Repeated rows of a document count as one, rows of one doc_id with other texts
as one document; repeated items are found each by its id. Ties don't matter: an occurrence is judged by sets of hits. Rows
without a doc_id can't be reported and aren't looked at; the pipeline keeps them. Extra columns aren't read.
"""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents

WINDOW, SHARE, LITERAL, BROADCAST_BYTES = 8, 50, 4, 32 << 20
#: a window that more than so many different items have is common
COMMON = 3
#: hits whose shifts follow each other at most this far apart may be of one occurrence, with words put in or left out
NEAR = 8

#: words of the shorter literal windows, and words in a row that are a copy however long the item is
SHORT, RUN = 5, 50
#: an item with fewer eligible template windows is also looked for by the template of all of it, and one with fewer literal windows
#: of its own, if it has common ones besides, by all of its text
FEW = 4
# Units of measure that follow a number.
UNITS = """kg g mg lb lbs oz ton tons tonnes km m cm mm mile miles mi ft feet foot inch inches yd yards l ml liter
liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month
months year years mph kph kmh percent dollar dollars usd eur euro euros pound pounds cent cents degree degrees c f k w
kw mb gb tb hz khz mhz ghz""".split()

#: a word, and one with a capital letter; what precedes the capital is never looked at twice
WORD = r"\\p{L}[\\p{L}\\p{M}\\p{N}]*"
CAPITAL = r"(?=\\p{L})[\\p{L}\\p{M}\\p{N}&&[^\\p{Lu}]]*+\\p{Lu}[\\p{L}\\p{M}\\p{N}]*+"
#: groups are repeated possessively, which Java does in a loop; else each repetition takes stack, and a long text's names or
#: numbers overflow it, which ends the executor. Nothing follows them, so what matches is the same
TOKEN = rf"\\p{{N}}++(?:[.,:/]\\p{{N}}++)*+|{CAPITAL}(?:[ \\n]++{CAPITAL})*+|{WORD}"


def _tokens(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """id; ``lit``, hashes of single words; ``can``, tokens, of which a name is one; ``tem``, their template (literal words are
    even, placeholders odd)."""
    d = df.select(F.col(id_col).alias(name), F.expr(f"regexp_extract_all(coalesce({text_col}, ''), '{TOKEN}', 0)").alias("can"))
    d = d.withColumn("low", F.expr("transform(can, x -> lower(x))"))
    # single words: names are cut at blanks, which few tokens hold
    blank = "(contains(x, ' ') or contains(x, '\\n'))"
    words = f"if(exists(low, x -> {blank}), flatten(transform(low, x -> if({blank}, split(x, '[ \\n]+'), array(x)))), low)"
    units = ", ".join(f"'{u}'" for u in UNITS)
    # a token begins with a letter or a number; ASCII ones are told apart without a pattern
    number = lambda x: f"({x} < ':' and {x} >= '0' or {x} >= '\u0080' and {x} rlike '^\\\\p{{N}}')"
    placed = f"case when {number('x')} then 1L when get(low, i) in ({units}) and i > 0 and {number('get(can, i - 1)')} then 3L when x <> get(low, i) then 5L else shiftleft(xxhash64(x), 1) end"
    return d.select(name, "can", F.expr(f"transform({words}, x -> xxhash64(x))").alias("lit"), F.expr(f"transform(can, (x, i) -> {placed})").alias("tem"))


def _windows(tokens: DataFrame, size: int | None, tsize: int | None, keep: list[str], words: bool = False) -> DataFrame:
    """One row a window and kind: pos, kind (0 literal, 1 template, 4 short literal, for the full size), key. Literal windows
    have ``size`` words, templates ``tsize`` tokens; None: none. With ``words`` the column lit is kept."""
    hashed = lambda of, n: "xxhash64(" + ", ".join(f"get({of}, pos + {k})" for k in range(n)) + ")"
    kinds, last = [], ["-1"]
    if size:
        kinds.append(f"struct(if(pos + {size} <= size(lit), 0, 9) as kind, {hashed('lit', size)} as key)")
        last.append(f"size(lit) - {SHORT if size == WINDOW else size}")
    if size == WINDOW:
        kinds.append(f"struct(if(pos + {SHORT} <= size(lit), 4, 9) as kind, {hashed('lit', SHORT)} as key)")
    if tsize:
        kinds.append(f"struct(if(pos + {tsize} <= size(can), 1, 9) as kind, {hashed('tem', tsize)} as key)")
        last.append(f"size(can) - {tsize}")
    # no condition on the arrays before they are made, else it would be pushed below and make them twice; without a window
    # there is one row without a place, whose kinds are all 9
    last = F.expr(f"greatest({', '.join(last)}, -1)")
    at = tokens.select(*keep, "can", "lit", "tem", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos"))
    cols = [*keep, "can", "tem", *(["lit"] if words else []), "pos"]
    both = at.select(*cols, F.explode(F.expr(f"array({', '.join(kinds)})")).alias("w"))
    return both.where("w.kind < 9").select(*cols, F.col("w.kind").alias("kind"), F.col("w.key").alias("key"))


def _theirs(items: DataFrame, size: int | None, tsize: int | None) -> tuple[DataFrame, DataFrame]:
    """The items' windows that are looked for, for items of ``size`` words or ``tsize`` tokens (WINDOW: at least); and for each item
    how many windows a share is taken of: windows, shorts, of (null for what isn't counted here).

    Kinds: 0 literal, 1 template, 4 short, as found; 2 and 3 stand for the whole template or text of an item, which is
    looked for from its rarest window. ``iown``: an item's own tokens in a window; ``item_tem``, ``item_can``, ``item_lit``: what a whole one has."""
    by_size = lambda of, n: F.least(F.size(of), F.lit(WINDOW)).eqNullSafe(F.lit(n).cast("int"))
    told = items.select("item", "can", "tem", "lit", F.col("lit").alias("ilit"), F.xxhash64("lit").alias("lclass"), F.xxhash64("tem").alias("tclass"))
    keep = ["item", "ilit", "lclass", "tclass"]
    each = _windows(told.where(by_size("lit", size)), size, None, keep) if size else None
    if tsize:
        templates = _windows(told.where(by_size("can", tsize)), None, tsize, keep)
        each = each.unionByName(templates) if each else templates
    # a window that more than COMMON different items have says nothing about any of them
    each = each.withColumn("class", F.when(F.col("kind") == 1, F.col("tclass")).otherwise(F.col("lclass")))
    sharing = each.groupBy("kind", "key").agg(F.count_distinct("class").alias("sharing"))
    words = f"size(filter(slice(tem, pos + 1, {tsize or 1}), x -> x % 2 = 0))"
    each = each.join(sharing, ["kind", "key"]).withColumn("own", F.col("sharing") <= COMMON).withColumn("words", F.when(F.col("kind") == 1, F.expr(words)))
    # template windows with too few literal words, or common ones, don't count on this side: what equals them is no hit
    each = each.withColumn("fit", F.col("own") & (F.coalesce(F.col("words"), F.lit(LITERAL)) >= min(LITERAL, tsize or LITERAL)))
    count = lambda kind, also=F.lit(True): F.count_if((F.col("kind") == kind) & also)
    item = each.groupBy("item", "lclass", "tclass").agg(
        count(0).alias("n0"),
        count(0, F.col("own")).alias("own0"),
        count(4).alias("n4"),
        count(4, F.col("own")).alias("own4"),
        count(1).alias("n1"),
        count(1, F.col("fit")).alias("eligible"),
        F.max(F.when(F.col("kind") == 1, F.struct(-F.col("sharing"), "words", -F.col("pos")))).alias("t"),
        F.min(F.when(F.col("kind") == 0, F.struct("sharing", "pos"))).alias("l"),
        F.max(F.expr(f"size(filter(tem, x -> x % 2 = 0)) >= {LITERAL}")).alias("enough"),
    )
    # the rest of an item with too few windows of its own must be there whole
    enough = lambda own, n: F.col(own) >= F.least(F.lit(FEW), F.col(n))
    of = F.when(F.col("eligible") >= FEW, F.col("eligible")).otherwise(F.col("n1"))
    counts = item.select("item", F.when(F.col("n0") > 0, F.when(enough("own0", "n0"), F.col("own0")).otherwise(F.col("n0"))).alias("windows"), F.when(enough("own4", "n4") & (F.col("n4") > 0), F.col("own4")).alias("shorts"), F.when(F.col("n1") > 0, of).alias("of"))
    each = each.join(item, ["item", "lclass", "tclass"])
    whole_text = (F.col("kind") == 0) & ~enough("own0", "n0")
    whole_template = (F.col("kind") == 1) & F.col("enough") & (F.col("eligible") < FEW) & (F.col("pos") == -F.col("t")["col3"])
    kind = F.when(whole_text, F.when(F.col("pos") == F.col("l")["pos"], 3)).when(F.col("kind") == 0, F.when(F.col("own"), 0)).when(F.col("kind") == 4, F.when(F.col("own") & enough("own4", "n4"), 4)).otherwise(F.when(F.col("fit"), 1).when(whole_template, 2))
    each = each.withColumn("from", whole_template).withColumn("type", F.col("kind")).withColumn("kind", kind).where("kind is not null")
    slots = F.when(F.col("kind") == 1, F.expr(f"slice(can, pos + 1, {tsize or 1})")).alias("iown")
    return each.select("item", F.col("pos").alias("ipos"), "kind", "type", "key", slots, F.when(F.col("from"), F.col("tem")).alias("item_tem"), F.when(F.col("from"), F.col("can")).alias("item_can"), F.when(F.col("kind") == 3, F.col("ilit")).alias("item_lit")), counts


def _hits(docs: DataFrame, theirs: DataFrame, size: int | None, tsize: int | None, broadcast_bytes: int) -> DataFrame:
    """doc, item, kind, item window, how far the document's window is from it, and the pairs of slot values where they are equal."""
    held = lambda c: F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0))
    bytes_, texts = theirs.agg(F.sum(80 + held("iown") + held("item_can") + 8 * F.coalesce(F.size("item_tem"), F.lit(0)) + 8 * F.coalesce(F.size("item_lit"), F.lit(0))), F.count_if(F.col("kind") == 3)).first()
    theirs = F.broadcast(theirs) if (bytes_ or 0) <= broadcast_bytes else theirs
    both = _windows(docs, size, tsize, ["doc"], bool(texts)).withColumnRenamed("kind", "type").join(theirs, ["key", "type"])
    both = both.withColumn("all", F.expr("case when item_tem is null or pos < ipos then false else slice(tem, pos - ipos + 1, size(item_tem)) = item_tem end"))
    found = "kind not in (2, 3) or all"
    both = both.where(f"{found} or kind = 3 and pos >= ipos and slice(lit, pos - ipos + 1, size(item_lit)) = item_lit" if texts else found)
    # every token of a window is a slot of its own value: literal words agree with themselves
    pairs = lambda mine, own: f"zip_with({own}, {mine}, (i, d) -> struct(lower(i) as i, lower(d) as d))"
    slots = f"case when all then {pairs('slice(can, pos - ipos + 1, size(item_can))', 'item_can')} when kind in (0, 3, 4) then cast(array() as array<struct<i:string,d:string>>) else {pairs(f'slice(can, pos + 1, {tsize or 1})', 'iown')} end"
    # literal windows and templates count their places apart: names of several words are one token of a template
    return both.select("doc", "item", "kind", F.col("kind").isin(1, 2).alias("typed"), "ipos", "all", (F.col("pos") - F.col("ipos")).alias("shift"), F.expr(slots).alias("slots"))


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, verdict and counts for every benchmark item found in a document."""
    scratch = Scratch(spark)
    bench = scratch.cut(_tokens(items.where("item_id is not null"), "item_id", "text", "item"), "items").where("size(can) > 0")
    # at most WINDOW sizes of each kind; a pass over the documents looks for one of each
    sizes = [sorted(r[0] for r in bench.select(F.least(F.size(c), F.lit(WINDOW))).distinct().collect()) for c in ("lit", "can")]
    mine = _tokens(docs.where("doc_id is not null"), "doc_id", "text", "doc")
    hits, counts = [], []
    for n, t in zip_longest(*(reversed(x) for x in sizes)):
        theirs, told = _theirs(bench, n, t)
        counts.append(told)
        hits.append(_hits(mine, scratch.cut(theirs, f"windows-{n}-{t}"), n, t, broadcast_bytes))
    if not hits:
        return spark.createDataFrame([], "doc_id long, item_id long, verdict string, windows long, literal_hits long, template_hits long, slots_agree boolean")
    # one row a shift first: its slots are those of one place, and at most the item's
    union = lambda col: F.array_distinct(F.flatten(F.collect_list(col))).alias(col)
    own = lambda kind, name: F.collect_set(F.when(F.col("kind") == kind, F.col("ipos"))).alias(name)
    each = reduce(DataFrame.unionByName, hits).groupBy("doc", "item", "typed", "shift").agg(own(0, "lit"), own(1, "tem"), own(4, "short"), F.max("all").alias("all"), F.max(F.col("kind") == 3).alias("text"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    counted = scratch.cut(reduce(DataFrame.unionByName, counts).groupBy("item").agg(F.max("windows").alias("windows"), F.max("of").alias("of"), F.max("shorts").alias("shorts")), "counts")
    each = each.join(counted, "item")
    each = each.withColumn("lit", F.sort_array("lit")).withColumn("run", F.expr(f"exists(transform(lit, (x, i) -> get(lit, i + {RUN - WINDOW}) - x), x -> x = {RUN - WINDOW})"))
    share = lambda col, of: (F.col(col) if isinstance(col, str) else col) * 100 >= F.col(of) * SHARE

    def judged(d: DataFrame) -> DataFrame:
        """With ``found``: whether it is an occurrence, its hits, and whether each value of the item has one value of
        the document, that is, no two pairs share the item's side. The greatest is the best."""
        d = d.withColumn("hits", F.size("tem").cast("long")).withColumn("agree", F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda z: z["i"]))))
        return d.withColumn("found", F.struct(((F.col("all") | share("hits", "of")) & F.col("agree")).alias("whole"), "hits", "agree"))

    # an occurrence is what has one shift, or shifts near each other, or all of the document
    order = W.partitionBy("doc", "item", "typed").orderBy("shift")
    parts = judged(each).withColumn("place", F.sum(F.when(F.col("shift") - F.lag("shift").over(order) > NEAR, 1).otherwise(0)).over(order))
    near = judged(parts.groupBy("doc", "item", "windows", "of", "shorts", "typed", "place").agg(F.max("run").alias("run"), F.max("text").alias("text"), union("short"), F.max("all").alias("all"), union("lit"), union("tem"), union("slots"), F.max("found").alias("one"))).withColumn("one", F.greatest("one", "found")).withColumn("run", F.coalesce("run", F.lit(False)) | F.coalesce(share(F.size("short"), "shorts"), F.lit(False)))
    rows = judged(near.groupBy("doc", "item", "windows", "of").agg(F.max("run").alias("run"), F.max("text").alias("text"), F.max("all").alias("all"), union("lit"), union("tem"), union("slots"), F.max("one").alias("one"))).withColumn("one", F.greatest("one", "found"))
    rows = rows.select("doc", "item", "windows", F.when(F.col("text"), F.col("windows")).otherwise(F.size("lit")).cast("long").alias("literal_hits"), F.col("one.hits").alias("template_hits"), F.col("one.agree").alias("slots_agree"), F.col("one.whole").alias("whole"), "run")
    verdict = F.when(share("literal_hits", "windows") | F.col("run"), "copy").when(F.col("whole"), "reparameterised")
    return rows.withColumn("verdict", verdict).where("verdict is not null").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "verdict", "windows", "literal_hits", "template_hits", "slots_agree")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: documents that hold benchmark items, one row for each pair."""
    return find(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, all rows of their doc_id with them; a row without one goes by its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    told = F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))
    found = find(spark, docs.select(told.alias("doc_id"), "text"), items).select("doc_id").distinct()
    return docs.join(found, told == found["doc_id"], "left_anti").select(*docs.columns)

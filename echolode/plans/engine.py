"""Scans: files to findings, limited to changed files or not, or from another tool's report."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from time import perf_counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config, ConfigError, validate
from ..operators import embed as E
from ..operators import expansion, incremental, knn, matches, overlap, snippets
from ..operators.scratch import Scratch
from ..operators.snapshots import Store
from ..operators.upkeep import Clusters
from ..sources import changes, external, tree


@dataclass(frozen=True)
class ScanResult:
    findings: DataFrame
    snippets: DataFrame | None
    stats: dict[str, int]
    config: Config
    timing: dict[str, float] = field(default_factory=dict)  # seconds by step
    evidence: DataFrame | None = None  # the matches behind the findings


def least_cosine(c: Config) -> float | None:
    """The cosine below which no pair can pass, as token overlap is 1 at most; None if cosine doesn't count."""
    t = c.thresholds
    w = t.lexical_weight
    return None if w >= 1 else (min(t.func, t.win, t.exp) - w) / (1 - w)


def positioned(found: DataFrame, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Snippets with pos, numbered by kind, path and place, so that ties don't depend on partitions. Numbers are made by
    counting range partitions, not by a sort in one task. What is ranged is written first, as ranges need a pass of their own; with ``then``, a
    step that keeps rows and their order, ``found`` is written already."""
    spark, order = found.sparkSession, ("kind", "path", "fn_id", "start_line", "end_line", "snippet_hash")
    scratch = Scratch(spark)
    found = found if then else scratch.cut(found, "found", "zstd")
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = scratch.cut((then(ranged) if then else ranged).withColumn("_id", F.monotonically_increasing_id()), "ordered", "zstd")
    part = F.shiftright("_id", 33)
    if not then:
        scratch.drop("found")
    sizes = ranged.groupBy(part.alias("_p")).count().orderBy("_p").collect()  # one row a partition
    starts, total = {}, 0
    for r in sizes:
        starts[r["_p"]], total = total, total + r["count"]
    if not starts:
        return ranged.withColumn("pos", F.col("_id")).drop("_id")
    told = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return ranged.withColumn("pos", told[part] + F.expr("_id & ((1L << 33) - 1)")).drop("_id")


def neighbours(snips: DataFrame, c: Config, narrow: DataFrame | None = None) -> DataFrame:
    """Neighbours by the configured index, at least those that can pass the thresholds; ``snips`` has pos, vec and tokens, ``narrow`` their sketches."""
    v = snips.select("pos", "vec")
    if c.index.name == "faiss":
        return knn.knn_cells(v, c.index.top_k, c.index.faiss_nlist, c.index.faiss_nprobe)
    return overlap.near(snips, c.index.top_k, least_cosine(c), c.thresholds, narrow)


def made_with(c: Config) -> dict:
    """What a remembered state depends on, besides the files."""
    e, w = c.embedder, c.windows
    return {"k": c.index.top_k, "least": least_cosine(c), "embedder": [e.name, e.model_name, e.revision, e.max_length], "windows": [w.window_lines, w.stride_lines, w.min_nonempty]}


def scan_tables(spark: SparkSession, sources: DataFrame, c: Config, normalise: bool = True, state: str = "", scope: DataFrame | None = None) -> ScanResult:
    """Findings among files (path, content, content_hash, language).

    ``state``: a folder that remembers neighbours from one scan to the next, so that only snippets of changed files are searched for.
    ``scope``: only findings with a side in these files (column path) are worked out; without it, all. Counts are those of rows as
    they are written, so no step is read again to be counted (but for files, of which a count needs no content)."""
    validate(c)
    scratch, timing, since, seen = Scratch(spark), {}, perf_counter(), {}

    def counted(d: DataFrame, name: str, *more: Column) -> DataFrame:
        seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return d.observe(seen[name], F.count(F.lit(1)).alias(name), *more)

    def done(step: str, d: DataFrame) -> DataFrame:
        """``d`` written, so that a step's time is its own."""
        nonlocal since
        out = scratch.cut(d, step)
        timing[step], since = perf_counter() - since, perf_counter()
        return out

    functions = done("extract_functions", counted(snippets.function_units(sources), "function_count"))
    units = functions.unionByName(snippets.text_units(sources))
    found = snippets.function_snippets(functions, normalise).unionByName(snippets.window_snippets(units, c.windows, normalise))
    if c.expansion.enabled and c.expansion.depth > 0:
        found = found.unionByName(expansion.call_snippets(sources, functions, c.expansion, normalise))
    found = done("generate_snippets", found)
    found, _ = E.embed(found, c.embedder, c.cache.path)
    hits = (F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses"))
    snips = done("embed", counted(positioned(found).withColumn("tokens", snippets.tokens("text")), "snippet_count", *hits))
    narrow = scratch.cut(overlap.sketches(snips, c.thresholds), "bits")
    if state:
        store = Store(spark, f"{state}/neighbours")
        near, _ = incremental.neighbours(store, snips, c.index.top_k, least_cosine(c), made_with(c))
        near = scratch.cut(near, "near")
        incremental.remember(store, snips, near, made_with(c))
    else:
        near = neighbours(snips, c, narrow)
    if scope is not None and not c.cluster_findings:  # a cluster may be held together by findings outside
        near = incremental.within(near, snips, scope)
    candidates = scratch.cut(counted(matches.candidates(snips, near, c.thresholds, narrow), "candidate_count"), "candidates")
    pairs = scratch.cut(matches.matches(candidates, c.thresholds.lexical_min_ratio), "matches")
    found = matches.findings(pairs, c.thresholds)
    if c.cluster_findings:
        found = matches.clusters(scratch.cut(found, "groups"), c.cluster_min_size, Clusters(spark, f"{state}/clusters") if state else None)
    found = done("similarity", counted(found, "finding_count"))
    counts = {"file_count": sources.count()} | {name: n for one in seen.values() for name, n in one.get.items()}
    result = ScanResult(found, snips, counts, c, timing, matches.evidence(pairs, found))
    return result if scope is None else limited(result, scope)


def scan(spark: SparkSession, paths: list[str], c: Config = Config(), state: str = "") -> ScanResult:
    """A scan by the configured engine; ``state`` is for the semantic one, others look at no snippets."""
    validate(c)
    run = ENGINES[c.engine]
    return run(spark, paths, c, state) if state and run is _semantic else run(spark, paths, c)


def _semantic(spark: SparkSession, paths: list[str], c: Config, state: str = "", scope: DataFrame | None = None) -> ScanResult:
    since = perf_counter()
    # written once: a tree may change while a scan reads it
    sources = Scratch(spark).cut(tree.read_tree(spark, paths, c.include_globs, c.exclude_globs), "sources")
    listed = {"collect_files": perf_counter() - since}
    result = scan_tables(spark, sources, c, state=state, scope=scope)
    return replace(result, timing=listed | result.timing)


def _external(spark: SparkSession, paths: list[str], c: Config) -> ScanResult:
    found = external.external_findings(spark)
    zero = dict.fromkeys(("file_count", "function_count", "snippet_count", "candidate_count", "cache_hits", "cache_misses"), 0)
    return ScanResult(found, None, zero | {"finding_count": found.count()}, c)


ENGINES: dict[str, Callable[[SparkSession, list[str], Config], ScanResult]] = {"semantic": _semantic, "sonarqube": _external}


def register_engine(name: str, run: Callable[[SparkSession, list[str], Config], ScanResult]) -> None:
    ENGINES[name] = run


def get_engine(name: str) -> Callable[[SparkSession, list[str], Config], ScanResult]:
    if name not in ENGINES:
        raise ConfigError(f"engine: {name!r} is not one of {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def limited(result: ScanResult, changed: DataFrame) -> ScanResult:
    """Findings with a side in the changed files (column path); only their count is replaced in the stats."""
    found = touched(result.findings, changed)
    evidence = result.evidence.join(found.select("fn_a", "fn_b"), ["fn_a", "fn_b"], "left_semi") if result.evidence is not None else None
    return replace(result, findings=found, evidence=evidence, stats=result.stats | {"finding_count": found.count()})


def touched(found: DataFrame, changed: DataFrame) -> DataFrame:
    """The findings with a side in the changed files (column path)."""
    told = changed.select("path").distinct()
    told = F.broadcast(told) if told.count() <= 1_000_000 else told
    strip = lambda c: F.regexp_replace(c, r"^\./", "")
    either = found.withColumn("_p", F.explode(F.array_distinct(F.array(strip("path_a"), strip("path_b")))))
    keep = either.join(told, F.col("_p") == told["path"], "left_semi").select("fn_a", "fn_b").distinct()
    return found.join(keep, ["fn_a", "fn_b"], "left_semi")


def diff(spark: SparkSession, base: str = "HEAD", paths: list[str] | None = None, c: Config = Config(), state: str = "") -> ScanResult:
    """A scan of ``paths``, limited to what git says has changed; without changes a scan of nothing. With ``state``, the folder that
    an earlier scan or diff has left, only what changed since then is searched for. candidate_count is that of the pairs in scope."""
    validate(c)
    names = [changes.shown(p) for p in changes.changed_files(base, paths)]
    scope = spark.createDataFrame([(n,) for n in names], "path string")
    if ENGINES[c.engine] is not _semantic or not names:
        return limited(scan(spark, (paths or ["."]) if names else [], c), scope)
    return _semantic(spark, paths or ["."], c, state, scope)

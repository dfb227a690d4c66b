r"""Secret scans with corpus-wide ownership frequency, by DataFrame functions only.

Each text is read once for four kinds of candidates. The base kinds ``assign``, ``access`` and
``hex`` are always reported. Then the hash of every candidate's value is counted over the whole
corpus by distinct repositories and distinct owners: a value that several owners have, or two owners
in many repositories, is a widely copied example; any other looks live. What the method adds are spans
of kind ``owned``: long mixed tokens that no base span overlaps and that a single owner has.

Spans are code points, end exclusive. A kind's matches are leftmost and do not overlap; their places
are running sums over the pieces between them, so that texts with very many matches stay linear.

Defined cases: null texts count as empty and have no spans; null repositories and owners count as one
each; repeated rows are scanned each, and count once for the frequencies; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_counted

#: The base patterns. Matches of assign with a shorter value than 6 are dropped afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OWNED = r"[A-Za-z0-9+/_-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owned": OWNED}
BASE = ("assign", "access", "hex")
#: A value of at least so many owners is an example that was copied; so is one of two owners in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20


def _found(text: Column, pattern: str) -> Column:
    """array<struct<gap, match>>: the matches, each with the length of the text since the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    zipped = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
    empty = F.array().cast("array<struct<gap:int,match:string>>")
    return F.when(text.rlike(pattern), zipped).otherwise(empty)


def _value(match: Column, kind: Column) -> Column:
    return F.when(kind == "assign", F.regexp_extract(match, ASSIGN, 2)).otherwise(match)


def candidates(scanned: DataFrame) -> DataFrame:
    """A row for each valid match: __llm_row, repository, owner, kind, start, end, the hash of its value, and whether a base match overlaps it."""
    kinds = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(k).alias("kind"), F.col(f"__llm_{k}").alias("found")) for i, k in enumerate(KINDS)])
    rows = scanned.select("__llm_row", "__llm_repo", "__llm_owner", F.explode(kinds).alias("k"))
    rows = rows.select("__llm_row", "__llm_repo", "__llm_owner", "k.no", "k.kind", F.posexplode("k.found").alias("at", "m"))
    by = Window.partitionBy("__llm_row", "no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("m.match")
    rows = rows.withColumn("end", F.sum((F.col("m.gap") + length).cast("long")).over(by)).withColumn("start", F.col("end") - length)
    rows = rows.withColumn("value", _value(F.col("m.match"), F.col("kind")))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    valid = F.when(F.col("kind") == "assign", F.length("value") >= 6).when(F.col("kind") == "owned", mixed).otherwise(True)
    rows = rows.filter(valid).select("__llm_row", "__llm_repo", "__llm_owner", "no", "kind", "start", "end", F.sha2("value", 256).alias("value_sha256"))
    base, place = F.col("kind").isin(*BASE), Window.partitionBy("__llm_row").orderBy("start", "end", "no")
    before = F.max(F.when(base, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    after = F.min(F.when(base, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    return rows.withColumn("covered", ~base & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))))


def ownership(found: DataFrame) -> DataFrame:
    """(value_sha256, repositories, owners, uses): over the whole corpus."""
    once = found.groupBy("value_sha256", F.struct("__llm_repo").alias("repo"), F.struct("__llm_owner").alias("owner")).agg(F.count("*").alias("n"))
    return once.groupBy("value_sha256").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("uses"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """For each row: id, n_assign, n_access, n_hex, base_sha256, spans, of its candidates n_example, n_live, n_owned, and in how many
    repositories and owners the most copied of its spans is found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("__llm_row"),
        F.col(id_col).alias("__llm_id"),
        F.col(repo_col).alias("__llm_repo"),
        F.col(owner_col).alias("__llm_owner"),
        *[_found(text, p).alias(f"__llm_{k}") for k, p in KINDS.items()],
    )
    scanned = checkpoint(scanned)
    found = checkpoint(candidates(scanned))
    known = join_counted(found, checkpoint(ownership(found)), "value_sha256", "uses", scanned.count())
    is_base = F.col("kind").isin(*BASE)
    example = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))
    known = known.filter(is_base | (F.col("owners") == 1) & ~F.col("covered"))
    span = F.struct("start", "no", "kind", "end")
    per = known.groupBy("__llm_row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(is_base & example, 1)).alias("n_example"),
        F.count(F.when(is_base & ~example, 1)).alias("n_live"),
        F.max("repositories").alias("most_repositories"),
        F.max("owners").alias("most_owners"),
        F.collect_list(F.when(is_base, span)).alias("__llm_base"),
        F.collect_list(span).alias("__llm_all"),
    )
    none = F.lit(0).cast("long")
    counts = [*(f"n_{k}" for k in BASE), "n_example", "n_live", "n_owned", "most_repositories", "most_owners"]
    joined = scanned.select("__llm_row", "__llm_id").join(per, "__llm_row", "left")
    return joined.select(
        F.col("__llm_id").alias(id_col),
        *[F.coalesce(F.col(c), none).alias(c) for c in counts],
        F.sha2(F.coalesce(_listed(F.col("__llm_base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("__llm_all")), F.lit("")).alias("spans"),
    )

"""Secret scan with multipart credential linking.

Single patterns find what is a secret by itself. Weak parts (a bare 40-character key, a short password, a user name, an
endpoint) are common in clean text; they are reported only where a complementary part stands within one scope: the
intervals of a document are joined by their distance, as a running nearest neighbour to each side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.llm.columns import text_or_empty
from equiscan.session import staged


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheaper test that every match passes; ``value`` the group whose length ``least`` to ``most`` bounds."""

    name: str
    pattern: str
    hint: str | None
    value: int
    least: int
    most: int
    role: str
    weak: bool


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_HINT = "(?i)password|passwd|secret|token|api_?key"
_ANY = 1_000_000_000
#: Code points between two parts of one credential.
SCOPE = 200

#: What the first three kinds match and their least lengths. A run that is too short holds no longer one, so
#: the length stands in the pattern. Every pattern walks a text once. The order is that of kinds in a result.
KINDS = [
    Kind("assign", _ASSIGN, _ASSIGN_HINT, 2, 12, _ANY, "secret", False),
    Kind("access", "AKIA[A-Z0-9]{14,}", "AKIA", 0, 18, _ANY, "identifier", False),
    Kind("hex", "[0-9a-f]{16,}", "[0-9a-f]{16}", 0, 16, _ANY, "other", False),
    Kind("key", "(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", "[A-Za-z0-9/+]{40}", 0, 40, 40, "secret", True),
    Kind("short", _ASSIGN, _ASSIGN_HINT, 2, 4, 11, "secret", True),
    Kind("user", r"""((?i:user(?:name)?|login|account|client_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", "(?i)user|login|account|client_id", 2, 3, 64, "identifier", True),
    Kind("endpoint", r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""", "://", 0, 8, 2048, "endpoint", True),
]
#: Roles of which one must be near for a weak part to count.
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def _matches(text: Column, pattern: str, kinds: list[tuple[int, Kind]]) -> Column:
    """All matches of one pattern: per match the length of the text since the last one, its own, and that of its value.

    What stands between matches is what a split at the pattern leaves, so both walk the text the same way.
    """
    hint, value = kinds[0][1].hint, max(k.value for _, k in kinds)
    lengths = lambda c: F.transform(c, F.char_length)
    found = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("length"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(value))).alias("value"),
    )
    seen = F.contains(text, F.lit(hint)) if hint.isalnum() or hint == "://" else text.rlike(hint)
    return F.when(seen, found)


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: ``id_col`` and spans, an array of (start, nth, kind, end), sorted; offsets are
    code points, the end is exclusive, nth is the place of the kind in :data:`KINDS`.

    The first three kinds are always reported. Of the weak kinds a span is reported if it overlaps none of those and a part
    of a complementary role lies within ``scope`` code points.

    Null and empty texts have no spans. Repeated rows and rows without id are scanned each by itself. Columns other than
    the two named are not read. Work grows with the matches of a document, never with their square. An empty table gives
    no rows.
    """
    patterns: dict[str, list[tuple[int, Kind]]] = {}
    for nth, kind in enumerate(KINDS):
        patterns.setdefault(kind.pattern, []).append((nth, kind))
    text = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    scanned = staged(
        text.select(
            F.monotonically_increasing_id().alias("row"), "doc", *(_matches(F.col("text"), p, kinds).alias(f"p{i}") for i, (p, kinds) in enumerate(patterns.items()))
        ),
        "secret-matches",
    )

    spans = None
    for i, kinds in enumerate(patterns.values()):
        one = scanned.where(F.col(f"p{i}").isNotNull()).select("row", F.posexplode(f"p{i}").alias("m", "x")).where("x.length IS NOT NULL").select("row", "m", "x.*")
        passed = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
        one = one.withColumn("end", passed.cast("long")).withColumn("start", F.col("end") - F.col("length"))
        which = F.coalesce(*(F.when(F.col("value").between(k.least, k.most), F.lit(nth)) for nth, k in kinds))
        one = one.select("row", "start", "end", which.alias("nth")).where("nth IS NOT NULL")
        spans = one if spans is None else spans.union(one)

    number = {k.name: nth for nth, k in enumerate(KINDS)}
    of_role = {role: [n for n, k in enumerate(KINDS) if k.role == role] for role in ("secret", "identifier", "endpoint")}
    strong = F.col("nth").isin([number[k.name] for k in KINDS if not k.weak])
    order = Window.partitionBy("row").orderBy("start", "nth")
    # What follows is a running value from the other end: a frame to the end would be computed anew for every row.
    backwards = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("nth").desc())
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, backwards))
    overlapped = F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False)
    )
    candidates = spans.withColumn("drop", ~strong & overlapped).where(~F.col("drop")).drop("drop")

    def near(role: str) -> Column:
        mine = F.col("nth").isin(of_role[role])
        left = F.col("start") - F.max(F.when(mine, F.col("end"))).over(before) <= scope
        right = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end") <= scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    candidates = candidates.withColumns({f"near_{role}": near(role) for role in of_role})
    linked = F.lit(False)
    for role, others in COMPLEMENTS.items():
        beside = F.lit(False)
        for other in others:
            beside = beside | F.col(f"near_{other}")
        linked = linked | (F.col("nth").isin(of_role[role]) & beside)
    kept = candidates.where(strong | linked)
    names = F.element_at(F.lit([k.name for k in KINDS]), F.col("nth") + 1)
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "nth", names.alias("kind"), "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,nth:int,kind:string,end:bigint>>")
    return scanned.select("row", "doc").join(by_row, "row", "left").select(F.col("doc").alias(id_col), F.coalesce("spans", none).alias("spans"))

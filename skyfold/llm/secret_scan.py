"""Secret scans by DataFrame functions only: strong patterns, and weak parts that count where complementary parts stand near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.llm.store import columns, others, written

# The base patterns, in the order of their kinds.
BASE = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE = 6
# Weak parts: identifiers, secrets and endpoints that mean little alone.
WEAK = {
    "weak_access": r"""(?:AKIA|ASIA)[A-Z0-9]{4,15}(?![A-Z0-9])|(?i:access_key_id|client_id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "weak_secret": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}",
    "endpoint": r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{2,5}""",
}
KINDS = [*BASE, *WEAK]
IDENTIFIERS, SECRETS = ["access", "weak_access"], ["assign", "hex", "weak_secret"]
SCOPE = 200  # code points before and after a part
SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def spans(text: Column, kind: str, pattern: str, keep=None, group: int = 0) -> Column:
    """``start, rank, end`` of the leftmost non-overlapping matches, in code points.

    A text is its matches and the pieces between them, so positions are running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    rank = F.lit(KINDS.index(kind))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + F.length(x["piece"])
        end = first + F.length(x["found"])
        new = F.array(F.struct(first.alias("start"), rank.alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), (F.concat(a["out"], new) if keep is None else F.when(keep(x["value"]), F.concat(a["out"], new)).otherwise(a["out"])).alias("out"))

    rows = F.arrays_zip(found.alias("found"), value.alias("value"), F.slice(pieces, 1, F.size(found)).alias("piece"))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def text_of(found: Column) -> Column:
    """``kind:start:end`` by start, then kind, then end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Columns of ``docs(text, ...)`` but the text, with ``n_assign, n_access, n_hex, base_spans, spans``.

    ``base_spans`` are the strong matches.  ``spans`` adds weak parts: an identifier with a secret in its scope, a secret with an
    identifier in its scope, an endpoint with both; the scope of a part reaches ``scope`` code points beyond its ends, and a partner
    belongs to it if it starts inside.  The interval join is an equi-join on document row and position bucket with the interval as
    condition, as a semi join, so pairs are never formed and a long text is many small keys.

    The text is read once: matches are written with a row number, which is the key of the join, so null or repeated doc_ids do no
    harm.  Null texts are empty; an empty table gives no rows; columns named like the new ones are replaced.
    """
    columns(docs, "text")
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "text"]
    keep = others(docs, *new)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {
        "assign": spans(text, "assign", BASE["assign"], lambda v: F.length(v) >= LEAST_VALUE, 1),
        "access": spans(text, "access", BASE["access"]),
        "hex": spans(text, "hex", BASE["hex"]),
        "weak_access": spans(text, "weak_access", WEAK["weak_access"]),
        "weak_secret": spans(text, "weak_secret", WEAK["weak_secret"], lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")),
        "endpoint": spans(text, "endpoint", WEAK["endpoint"]),
    }
    parts = docs.select(*keep, F.monotonically_increasing_id().alias("__se_row"), *[v.alias(f"__se_{k}") for k, v in found.items()])
    parts = written(parts, "secret-parts")
    weak = [f"__se_{k}" for k in WEAK]
    rows = parts.filter(" OR ".join(f"size({c}) > 0" for c in weak))
    part = rows.select("__se_row", F.explode(F.concat(*[F.col(f"__se_{k}") for k in KINDS])).alias("s")).select("__se_row", "s.*")
    width = 2 * scope + 1
    far = part.select("__se_row", "start", "rank", "end", F.explode(F.sequence(F.floor((F.col("start") - scope) / width), F.floor((F.col("end") + scope) / width))).alias("bucket"))

    def near(left: DataFrame, kinds: list[str]) -> DataFrame:
        ranks = [KINDS.index(k) for k in kinds]
        right = part.filter(F.col("rank").isin(ranks)).select(F.col("__se_row").alias("row"), F.floor(F.col("start") / width).alias("b"), F.col("start").alias("at"))
        on = (F.col("__se_row") == F.col("row")) & (F.col("bucket") == F.col("b")) & (F.col("at") >= F.col("start") - scope) & (F.col("at") <= F.col("end") + scope)
        return left.join(right, on, "left_semi")

    def of(kind: str) -> DataFrame:
        return far.filter(F.col("rank") == KINDS.index(kind))

    span = ["__se_row", "start", "rank", "end"]
    ends = near(of("endpoint"), SECRETS).select(*span).distinct()
    ends = ends.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - scope) / width), F.floor((F.col("end") + scope) / width))))
    linked = near(of("weak_access"), SECRETS).select(*span).unionByName(near(of("weak_secret"), IDENTIFIERS).select(*span)).unionByName(near(ends, IDENTIFIERS).select(*span)).distinct()
    more = linked.groupBy("__se_row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("__se_more"))
    base = F.concat(*[F.col(f"__se_{k}") for k in BASE])
    return parts.join(more, "__se_row", "left").select(
        *keep, *[F.size(f"__se_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        text_of(base).alias("base_spans"), text_of(F.concat(base, F.coalesce(F.col("__se_more"), F.array().cast(SPAN)))).alias("spans"),
    )


def digest(docs: DataFrame) -> DataFrame:
    out = find_secrets(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")

"""Secret scan with multipart credential linking, in DataFrame expressions only.

Strong kinds are reported wherever they match: assignments of secrets (assign), access
identifiers (access) and long hexadecimal runs (hex). Weak kinds are candidates: logins,
opaque mixed runs and service endpoints. A candidate is reported only when the parts that
complete it lie in its scope: a login needs a secret, an opaque run needs an identifier, an
endpoint needs both. A scope is the block of a text that blank lines bound (a section of a
configuration, a group of lines), within it what starts at most ``scope`` code points away.

Positions: between matches a text is split by the same pattern, so a match starts after the
pieces and matches before it, and its block's number is how many runs of blank lines they
hold; both are running sums over the matches of one document. The interval join of a
candidate with its parts uses the nearest part of each class on either side in its block,
found by running windows: linear in the matches, no pairs.

Only matches are shuffled, by document and text hash; texts are not, and documents without
a match leave the plan at the scan.

Edge cases: null text is empty and has no spans; a null id stays null; equal rows each get
the spans of their text; matches that fail their minimum length still consume their
characters; very long texts are scanned whole; no rows, no result. Columns other than id and
text are not read by ``scan``, whatever their names; ``redact`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filigree.session import table

KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "login": r"""(?i)(username|user|login|client_id|account_id|key_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""",
    "opaque": r"[A-Za-z0-9+/_-]{32,}",
    "endpoint": r"(?:https?|ftp|ssh|postgresql|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+",
}
SCOPE = 400
#: What bounds a block: a line end and one or more blank lines. No match holds a line end.
BLANK_LINES = r"\n(?:[ \t\r]*\n)+"


def _worth(text: Column) -> Column:
    """Whether a text can have a span: a strong kind, or a login with an opaque run."""
    has = {k: text.rlike(PATTERNS[k]) for k in ("assign", "access", "hex", "login", "opaque")}
    return has["assign"] | has["access"] | has["hex"] | (has["login"] & has["opaque"])


def _matches(text: Column) -> Column:
    """An array of (kind number, number in its kind, characters and block bounds before it, match)."""

    def of(number: int, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        before = F.transform(F.split(text, PATTERNS[kind], -1), lambda x: F.struct(F.length(x).alias("n"), F.regexp_count(x, F.lit(BLANK_LINES)).alias("breaks")))
        zipped = F.filter(F.arrays_zip(before.alias("before"), found.alias("match")), lambda x: x["match"].isNotNull())
        return F.transform(zipped, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), x["before"]["n"].alias("before"), x["before"]["breaks"].alias("breaks"), x["match"].alias("match")))

    return F.flatten(F.array(*(of(number, kind) for number, kind in enumerate(KINDS))))


def _valid(kind: Column, match: Column) -> Column:
    mixed = match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")
    return (
        F.when(kind == 0, F.length(F.regexp_extract(match, PATTERNS["assign"], 2)) >= 6)
        .when(kind == 1, F.length(match) >= 20)
        .when(kind == 4, mixed)
        .otherwise(F.lit(True))
    )


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc, key, kind, start, end) of every reported span; docs has doc, text and key."""
    found = docs.where(_worth(F.col("text"))).select("doc", "key", F.explode(_matches(F.col("text"))).alias("m")).select("doc", "key", "m.*")
    found = found.repartition("doc", "key").dropDuplicates(["doc", "key", "kind", "i"])
    own = W.partitionBy("doc", "key", "kind").orderBy("i")
    size = F.length("match").cast("long")
    upto = F.sum(F.col("before").cast("long") + size).over(own.rowsBetween(W.unboundedPreceding, 0))
    block = F.sum("breaks").over(own.rowsBetween(W.unboundedPreceding, 0))
    at = found.withColumn("block", block).withColumn("end", upto).withColumn("start", F.col("end") - size).where(_valid(F.col("kind"), F.col("match")))
    kind = F.col("kind")
    classes = {"secret": kind.isin(0, 2), "weak_secret": kind == 4, "id": kind == 1, "weak_id": kind == 3}
    before = W.partitionBy("doc", "key", "block").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("doc", "key", "block").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)

    def near(test: Column) -> Column:
        place = F.when(test, F.col("start"))
        back = F.col("start") - F.last(place, ignorenulls=True).over(before) <= scope
        ahead = F.last(place, ignorenulls=True).over(after) - F.col("start") <= scope
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    secret, weak_secret = classes["secret"], classes["weak_secret"]
    at = at.withColumn("near_secret", near(secret | weak_secret)).withColumn("near_id", near(classes["id"] | classes["weak_id"]))
    told = F.when(kind <= 2, F.lit(True)).when(kind == 3, F.col("near_secret")).when(kind == 4, F.col("near_id")).otherwise(F.col("near_secret") & F.col("near_id"))
    return at.where(told).select("doc", "key", "kind", "start", "end")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("key"))


def _joined(of: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _by_document(found: DataFrame) -> DataFrame:
    one = F.struct("start", "kind", "end")
    return found.groupBy("doc", "key").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(3)),
        F.sort_array(F.collect_list(F.when(F.col("kind") <= 2, one))).alias("base"),
        F.sort_array(F.collect_list(one)).alias("all"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs."""
    keyed = _keyed(docs, id_col, text_col)
    found = _by_document(spans(keyed, scope)).withColumnsRenamed({"doc": "doc_", "key": "key_"})
    rows = keyed.select("doc", "key")
    out = rows.join(found, rows.doc.eqNullSafe(found.doc_) & (rows.key == found.key_), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("doc").alias("doc_id"),
        *(F.coalesce(F.col(f"n{k}"), zero).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs, all columns, with every run of overlapping reported spans replaced by `mark`.

    Null and empty texts stay as they are; rows with equal id and text are changed alike; no
    rows, no result. Columns may have any names and types: they travel as one struct.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    clean = docs.where(~_worth(text))
    maybe = docs.where(_worth(text)).select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("key"))
    found = _by_document(spans(maybe.select("doc", "text", "key"), scope)).select("doc", "key", F.col("all").alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        plain = F.substring(F.col("text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        out = F.when(x["start"] >= a["at"], F.concat(a["out"], plain, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

    ends = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    hidden = F.when(F.col("spans").isNull(), F.col("row").getField(text_col)).otherwise(F.aggregate("spans", start, step, ends))
    joined = maybe.join(found, maybe["doc"].eqNullSafe(found["doc"]) & (maybe["key"] == found["key"]), "left")
    return clean.unionByName(joined.select(*(hidden.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """DuckDB SQL with the same patterns."""
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    each = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, unnest(generate_series(1, len(m))) AS i, unnest(m) AS match, unnest(list_transform(b[1 : len(m)], lambda x: length(x))) AS before, "
        f"unnest(list_transform(b[1 : len(m)], lambda x: len(regexp_extract_all(x, '{BLANK_LINES}')))) AS breaks "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{quoted[k]}') AS m, regexp_split_to_array(text, '{quoted[k]}') AS b FROM d WHERE regexp_matches(text, '{quoted[k]}'))"
        for n, k in enumerate(KINDS)
    )
    near = lambda kinds: f"""EXISTS (SELECT 1 FROM v o WHERE o.doc_id = v.doc_id AND o.block = v.block AND o.kind IN {kinds} AND (o.kind, o.start) <> (v.kind, v.start) AND abs(o.start - v.start) <= {SCOPE})"""
    name = "CASE kind " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END"
    joined = f"string_agg({name} || ':' || start || ':' || fin, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({each}),
p AS (SELECT *, sum(before + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS fin, sum(breaks) OVER (PARTITION BY doc_id, kind ORDER BY i) AS block FROM m),
v AS MATERIALIZED (
  SELECT doc_id, kind, block, CAST(fin - length(match) AS BIGINT) AS start, CAST(fin AS BIGINT) AS fin FROM p
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(match, '{quoted["assign"]}', 2)) >= 6 WHEN 1 THEN length(match) >= 20
        WHEN 4 THEN regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]') ELSE true END
),
t AS (
  SELECT * FROM v WHERE kind <= 2 OR (kind = 3 AND {near("(0, 2, 4)")}) OR (kind = 4 AND {near("(1, 3)")})
     OR (kind = 5 AND {near("(0, 2, 4)")} AND {near("(1, 3)")})
),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex, {joined} FILTER (WHERE kind <= 2) AS base, {joined} AS spans
  FROM t GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


OP4_SQL = _sql()

"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer version) are additive: documents, tokens and
characters. A batch of signed rows (+1 insert, -1 delete; a revised document is
both) is summed map-side first and written as one small table to a folder of its own.
When that write has ended, an empty marker file, made in one step, publishes the
folder as the batch's; only published folders are read. A commit that fails
half-way therefore leaves what was published before, a batch that is committed
again counts once (``replace`` publishes a newer folder instead), and a batch
asked for but never published is an error. Totals are the sums over all
committed batches; ``compact`` folds them.

Defined cases: a null text has no tokens and no characters but is a document;
null keys are a group of their own; repeated rows count each; a group whose
documents all went has no row; an empty batch adds nothing; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
# Tokenizer versions: pattern of a token.
TOKENIZERS = {"words-1": r"[^ \t\n\x0B\f\r]+", "words-2": r"[0-9]|[A-Za-z]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"}
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"


def signed_counts(docs: DataFrame, sign: int, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """One row per document and tokenizer version, its counts times ``sign``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counts = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.regexp_count(text, F.lit(pattern)).alias("n"))
                       for name, pattern in tokenizers.items()])
    return docs.select("source", "lang", F.length(text).alias("chars"), F.explode(counts).alias("t")).select(
        "source", "lang", "t.tokenizer", F.lit(sign).cast("long").alias("n_docs"),
        (sign * F.col("t.n")).cast("long").alias("n_tokens"), (sign * F.col("chars")).cast("long").alias("n_chars"))


def inserts(docs: DataFrame, **kw) -> DataFrame:
    return signed_counts(docs, 1, **kw)


def deletes(docs: DataFrame, **kw) -> DataFrame:
    return signed_counts(docs, -1, **kw)


def revisions(before: DataFrame, after: DataFrame, **kw) -> DataFrame:
    """Old counts out, new counts in."""
    return deletes(before, **kw).union(inserts(after, **kw))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def _published(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """By batch, the latest published version and its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: dict[str, tuple[int, str]] = {}
    for f in fs.listStatus(folder) if fs.exists(folder) else ():
        batch, version, name = f.getPath().getName().rsplit("~", 2)
        found[batch] = max(found.get(batch, (0, "")), (int(version), name))
    return found


def _claimed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether this is the first write of the batch, whose folder bears the batch's name; later ones
    (of a retry, or of a new version) get folders of their own."""
    if batch.startswith(("_", ".")):
        return False
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claimed/{batch}")
    return claim.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).createNewFile(claim)


def commit(path: str, batch: str, rows: DataFrame, replace: bool = False) -> None:
    """Write and publish one batch; ``batch`` is a name without slashes. A batch
    that is published already stays as it is, unless ``replace``."""
    spark = rows.sparkSession
    version = _published(spark, path).get(batch, (0, ""))[0]
    if version and not replace:
        return
    name = batch if _claimed(spark, path, batch) else uuid.uuid4().hex
    _sums(rows).write.parquet(f"{path}/{name}")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published/{batch}~{version + 1}~{name}")
    marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(marker, False).close()


def totals(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    """Sums over the named committed batches; groups without documents go."""
    published = _published(spark, path)
    if lost := [b for b in batches if b not in published]:
        raise ValueError(f"not committed: {', '.join(lost)}")
    parts = [spark.read.schema(SCHEMA).parquet(f"{path}/{published[b][1]}") for b in dict.fromkeys(batches)]
    rows = reduce(DataFrame.union, parts, spark.createDataFrame([], SCHEMA))
    return _sums(rows).filter(" OR ".join(f"{c} <> 0" for c in SUMS))


def compact(spark: SparkSession, path: str, batches: list[str], into: str) -> list[str]:
    """Fold batches into one; returns the names to use from now on."""
    commit(path, into, totals(spark, path, batches), replace=True)
    return [into]


def scrubbed(text: Column) -> Column:
    """The revised text of the registered query: without digits."""
    return F.regexp_replace(text, "[0-9]", "")


_SQL_COUNT = {
    "words-1": r"len(regexp_extract_all({t}, '[^ \t\n\x0B\f\r]+'))",
    "words-2": r"len(regexp_extract_all({t}, '[0-9]|[A-Za-z]+|[^\x00-\x7F]+|[!-/:-@\[-`{{-~]'))",
}


def oracle_sql() -> str:
    parts = [f"SELECT source, lang, '{name}' AS tokenizer, count(*) AS n_docs, "
             f"CAST(sum({count.format(t='t')}) AS BIGINT) AS n_tokens, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM d GROUP BY ALL"
             for name, count in _SQL_COUNT.items()]
    return ("WITH d AS (SELECT source, lang, regexp_replace(text, '[0-9]', '', 'g') AS t FROM documents WHERE length(text) >= 100) "
            + " UNION ALL ".join(parts))

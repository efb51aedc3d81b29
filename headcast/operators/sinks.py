"""Write semantics over Parquet tables: what a keyed store does on conflict, as joins and aggregates.

Each function returns the new content of the target. ``write_partitions`` replaces only the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET_KEYS = ("key", "api_key", "apikey", "token", "password")


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key by ``order``, unless the target has the key (nulls are equal)."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*(order or batch.columns))).alias("__r")).select("__r.*")
    other = target.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return first.join(other, on, "left_anti")


def overwrite(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest row of each key over both tables."""
    both = target.unionByName(batch)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(version, *[c for c in both.columns if c != version])).alias("__r")).select("__r.*")


def coalescing_upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Column by column the newest value that isn't null."""
    both = target.unionByName(batch)
    values = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(version), F.col(c)))).alias(c) for c in values])


def accumulate(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merges ``n``, ``mean``, ``low`` and ``high`` of both tables."""
    both = target.unionByName(batch)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def replace_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch, and the target's rows of all keys that the batch doesn't name."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions of ``path`` that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def conform(df: DataFrame, columns: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns in the given order and types: missing ones are added, bad values become null, defaults fill nulls."""
    have, defaults = set(df.columns), defaults or {}
    out = []
    for name, kind in columns.items():
        value = F.col(f"`{name}`").try_cast(kind) if name in have else F.lit(None).cast(kind)
        out.append((F.coalesce(value, defaults[name].cast(kind)) if name in defaults else value).alias(name))
    return df.select(*out)


def scrub(params: Column, secret: Sequence[str] = SECRET_KEYS) -> Column:
    """A map of request parameters without its secrets."""
    return F.transform_values(params, lambda k, v: F.when(F.lower(k).isin(*secret), "<redacted>").otherwise(v))


def scrub_url(url: Column, secret: Sequence[str] = SECRET_KEYS) -> Column:
    return F.regexp_replace(url, f"(?i)([?&](?:{'|'.join(secret)})=)[^&#]*", "$1<redacted>")


def content_hash(body: Column) -> Column:
    """Hash of a body; of JSON in canonical form (keys sorted, no space between), of anything else as it stands."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(body)), body), 256)


def body_text(body: Column, content_type: Column) -> Column:
    """A binary body as text if its type says so, else in base 64 behind a mark, however long without line breaks."""
    return F.when(content_type.rlike("(?i)json|xml|text|html|csv"), F.decode(body, "UTF-8")).otherwise(F.concat(F.lit("BASE64:"), F.translate(F.base64(body), "\r\n", "")))

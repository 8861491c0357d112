"""Readers and writers: page snapshots, term corpora, findings, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import SEPARATOR, joined_hash
from ..operators.disposition import OPEN, stamped
from . import buckets

# The fields of stored pages and corpora.
SNAPSHOT = (
    "url string, bron_id string, taal string, familie string, familie_sleutel string, titel string, opgehaald_op string, http_status int, "
    "koppen array<struct<niveau: int, tekst: string>>, tekst string, "
    "tabellen array<struct<`index`: int, kolomkoppen: array<string>, rijen: array<struct<label: string, waarde_rauw: string>>>>, "
    "secties array<struct<stap: string, titel: string, niveau: int, tekst: string, koppen: array<struct<niveau: int, tekst: string, uitklap: boolean>>>>, extractie_versie int"
)
CORPUS = "url string, taal string, site string, titel string, tekst string, opgehaald_op string, content_hash string"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a JSON-lines snapshot, with an explicit schema; blank lines and missing lists are empty."""
    rows = spark.read.schema(SNAPSHOT).json(path).where(F.col("url").isNotNull())
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])) for c in ("koppen", "tabellen", "secties")})


def snapshot_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of a snapshot: page, table_row, heading, section, section_heading."""
    key = [F.col("familie").alias("family"), "url"]
    tables = pages.select(*key, F.posexplode("tabellen").alias("table_idx", "t")).select("family", "url", "table_idx", F.posexplode("t.rijen").alias("row_idx", "r"))
    sections = pages.select(*key, F.posexplode("secties").alias("ord", "s"))
    return {
        "page": pages.select(*key, F.col("familie_sleutel").alias("variant"), F.col("titel").alias("title"), F.col("tekst").alias("text")),
        "table_row": tables.select("family", "url", "table_idx", "row_idx", (F.col("table_idx") * 100000 + F.col("row_idx")).alias("ord"), "r.label", F.col("r.waarde_rauw").alias("value_raw")),
        "heading": pages.select(*key, F.posexplode("koppen").alias("ord", "h")).select("family", "url", "ord", F.col("h.niveau").alias("level"), F.col("h.tekst").alias("text")),
        "section": sections.select("family", "url", "ord", F.col("s.stap").alias("step"), F.col("s.titel").alias("title"), F.col("s.niveau").alias("level"), F.col("s.tekst").alias("text")),
        "section_heading": sections.select("family", "url", F.col("ord").alias("sec_ord"), F.posexplode("s.koppen").alias("ord", "h")).select(
            "family", "url", "sec_ord", "ord", F.col("h.niveau").alias("level"), F.col("h.tekst").alias("text"), F.coalesce("h.uitklap", F.lit(False)).alias("is_toggle")),
    }


#: Pages of a family that share a file; smaller families are one file, sorted by URL, that can be compared line by line.
PER_FILE = 20_000


def write_snapshot(pages: DataFrame, path: str, date: str) -> None:
    """A snapshot partitioned by date and family; files are sorted by URL inside, and only the families written are replaced."""
    size = pages.groupBy("familie").agg(F.ceil(F.count("*") / PER_FILE).alias("__files"))
    rows = pages.join(size, "familie").withColumn("family", F.col("familie")).withColumn("__file", F.pmod(F.xxhash64("url"), F.col("__files")))
    rows = rows.repartition("family", "__file").drop("__files", "__file").sortWithinPartitions("family", "url")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family").json(f"{path}/dt={date}")


def read_snapshots(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """All snapshots under a folder, with ``dt`` and ``family``: a filter on these opens only the files it is about."""
    rows = spark.read.schema(f"{SNAPSHOT}, dt string, family string").option("mode", mode).json(path).where(F.col("url").isNotNull())
    return rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])) for c in ("koppen", "tabellen", "secties")})


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of a folder's ``*.jsonl`` (or what ``write_corpus`` has written); missing fields are empty, missing hashes are computed."""
    rows = spark.read.schema(CORPUS).option("pathGlobFilter", "*.json*").json(folder).where(F.col("url").isNotNull()).na.fill("")
    return rows.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), F.substring(F.sha2("tekst", 256), 1, 16)))


def write_corpus(pages: DataFrame, folder: str) -> None:
    pages.sortWithinPartitions("url").write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def latest(spark: SparkSession, path: str, family: str | None = None) -> DataFrame:
    """The rows of each family's newest date; dates are partition names compared as text."""
    rows = spark.read.option("partitionColumnTypeInference.enabled", "false").parquet(path).withColumn("dt", F.col("dt").cast("string"))
    if family is not None:
        rows = rows.where(F.col("family") == family)
    newest = rows.select("family", "dt").distinct().groupBy("family").agg(F.max("dt").alias("dt"))
    return rows.join(newest, ["family", "dt"], "left_semi")


def write_findings(findings: DataFrame, path: str, date: str) -> None:
    """Findings as a table by date and family, replacing only the dates and families written."""
    rows = findings.withColumn("dt", F.lit(date))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "family").parquet(path)


def export_json(rows: DataFrame, path: str, *order: str) -> None:
    """Sorted JSON lines for people and version control; Spark range-partitions for the order."""
    names = sorted(rows.columns)
    rows.orderBy(*order).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


# Fixed shape of findings as they are exchanged: what was observed is "variant: value | variant: value".
FINDINGS_JSON = "regel_id string, soort string, titel string, urls array<string>, waargenomen string, categorie string, vingerafdruk string"


#: A finding's pages are dealt over tasks in this many blocks at most, of as many pages at least.
BLOCKS, BLOCK_PAGES = 64, 256


def read_findings_json(spark: SparkSession, path: str) -> DataFrame:
    """(finding_id, rule, url, variant, values, evidence_hash): the pages of findings that were exchanged as JSON, each with what it shows.

    Where there are as many variants as URLs each page has its own; or else every page has all.
    What all pages show is worked out once for a finding and travels with each of its blocks of
    pages; the hash of a page covers all of it, so such a finding's hashing grows with its pages times its variants.
    """
    rows = spark.read.schema(FINDINGS_JSON).json(path).where("vingerafdruk is not null")
    parts = F.transform(F.split("waargenomen", r" \| ", -1), lambda x: F.struct(F.regexp_extract(x, "(?s)^(.*?): ", 1).alias("variant"), F.regexp_extract(x, "(?s)^.*?: (.*)$", 1).alias("value")))
    told = F.filter(F.coalesce(parts, F.array().cast("array<struct<variant: string, value: string>>")), lambda x: x["value"] != "")
    each = rows.where("urls is not null").select(F.col("vingerafdruk").alias("finding_id"), F.col("regel_id").alias("rule"), "urls", told.alias("told"))
    own = F.zip_with("urls", "told", lambda u, v: F.struct(u.alias("url"), v["variant"].alias("variant"), v["value"].alias("value")))
    none = F.lit(None).cast("string")
    alone = F.size("urls") == F.size("told")
    all_values = F.transform("told", lambda x: x["value"])
    each = each.select(
        "finding_id", "rule", alone.alias("alone"), F.when(alone, own).otherwise(F.transform("urls", lambda u: F.struct(u.alias("url"), none.alias("variant"), none.alias("value")))).alias("pages"),
        F.get("told", F.lit(0))["variant"].alias("first"), F.when(~alone, all_values).alias("all"), F.when(~alone & (F.size("told") > 0), F.array_join(all_values, SEPARATOR)).alias("text"))
    each = each.withColumn("per", F.greatest(F.lit(BLOCK_PAGES), F.ceil(F.size("pages") / BLOCKS)).cast("int")).where(F.size("pages") > 0)
    starts = F.sequence(F.lit(1), F.size("pages"), F.col("per"))
    blocks = each.select("finding_id", "rule", "alone", "first", "all", "text", F.posexplode(F.transform(starts, lambda i: F.slice("pages", i, F.col("per")))).alias("block", "pages"))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "finding_id", "block")
    of = blocks.select("finding_id", "rule", "alone", "first", "all", "text", F.explode("pages").alias("p"))
    shown = F.when(F.col("alone"), F.col("p.value")).otherwise(F.col("text"))
    return of.select(
        "finding_id", "rule", "p.url", F.coalesce("p.variant", "first", "p.url").alias("variant"), F.when(F.col("alone"), F.array("p.value")).otherwise(F.col("all")).alias("values"), joined_hash(F.col("p.url"), shown).alias("evidence_hash"))


def exists(spark: SparkSession, path: str) -> bool:
    where = type_path(spark, path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def type_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


# Fixed shape of published panels.
PANELS = "family string, name string, dt string, place int, findings long, html string"


def publish_panels(panels: DataFrame, folder: str) -> None:
    """Upsert panels by family: families not in ``panels`` stay as they are."""
    buckets.upsert(panels.select("family", "name", "dt", "place", "findings", "html"), folder, ["family"])


def read_panels(spark: SparkSession, folder: str) -> DataFrame:
    return buckets.read(spark, folder, PANELS)


# Fixed shape of stored dispositions.
DISPOSITIONS = "finding_id string, url string, status string, evidence_hash string, checked string, ts timestamp, seq long, written_by string, written_at timestamp"


def write_dispositions(updates: DataFrame, folder: str, user: str) -> None:
    """Put decisions (finding_id, url, status, evidence_hash, checked, ts, seq) into the table, with who wrote them and when, whatever they say themselves."""
    rows = stamped(updates, user)
    buckets.upsert(rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DISPOSITIONS.split(", ")]), folder, ["finding_id", "url"], ["ts", "seq"])


def read_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions that stand: a last write of 'open' takes one back."""
    return buckets.read(spark, folder, DISPOSITIONS).where(F.col("status") != OPEN)


RUNS = "family string, dt string, pages long, fetched string, warnings array<string>"


def write_run(spark: SparkSession, path: str, family: str, date: str, pages: int, fetched: str | None, warnings: list[str]) -> None:
    """What a run looked at, beside its findings: number of pages, newest fetch, warnings."""
    row = spark.createDataFrame([(family, date, pages, fetched, warnings)], RUNS)
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "family").parquet(path)


def checked_families(families: DataFrame, findings: DataFrame) -> DataFrame:
    """Families (family, ...) that have a run, with its date; those never run are left out."""
    return families.join(findings.groupBy("family").agg(F.max("dt").alias("dt")), "family")

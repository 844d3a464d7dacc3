"""Reference lists: schemas, loading with fall-back, validation, refresh, diff."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from phishlake import fixed_values as fv
from phishlake.functions.hosts import list_entry, list_entry_is_valid
from phishlake.operators.lookups import ListTable, last_per_domain
from phishlake.sources.workdir import materialised

# top-level JSON shape of each list file
FILE_SCHEMAS = {
    "institutions": "version string, institutions array<struct<domain:string,name:string,"
                    "category:string,official_url:string,high_value:boolean>>",
    "known_bad": "version string, last_updated string, source string, domains array<string>",
    "sender_orgs": "version string, organizations array<struct<id:string,name:string,"
                   "category:string,aliases:array<string>,sending_domains:array<string>,"
                   "reply_to_domains:array<string>,official_contact_url:string,"
                   "official_phone:string,notes:string>>",
    "keyword_categories": "version string, categories map<string,struct<weight:int,cap:int,"
                          "structural:boolean,terms:array<string>,terms_fr:array<string>,"
                          "sin_terms:array<string>,cvv_terms:array<string>,"
                          "gov_suffixes:array<string>>>",
    "rules": "version string, rules array<struct<id:string,weight:int,match:string,"
             "user_explanation:string,user_explanation_fr:string>>",
}
ENTRY_COLUMN = {
    "institutions": "institutions", "known_bad": "domains", "sender_orgs": "organizations",
    "keyword_categories": "categories", "rules": "rules",
}


#: Entries of one line of a list in shards.
SHARD_ENTRIES = 10_000


def load_file(spark: SparkSession, name: str, live_dir: str | None,
              bundled_dir: str | None) -> DataFrame:
    """The list file: live copy, else bundled copy, else an empty frame.

    ``name.json`` is one document; a long list is ``name.jsonl``, a folder of lines that are
    documents with a part of the entries each and the position of the ``first`` of them.
    """
    for folder in (live_dir, bundled_dir):
        if folder:
            base = f"{folder.rstrip('/')}/{name}"
            for path, whole in ((f"{base}.jsonl", False), (f"{base}.json", True)):
                df = _read_file(spark, name, path, whole)
                if df is not None:
                    return df
    return spark.createDataFrame([], f"{FILE_SCHEMAS[name]}, first long")


def _read_file(spark: SparkSession, name: str, path: str, whole: bool) -> DataFrame | None:
    """None for a file that is not there or holds no entries."""
    try:
        df = spark.read.schema(f"{FILE_SCHEMAS[name]}, first long").option("multiLine", whole).json(path)
        if df.filter(F.col(ENTRY_COLUMN[name]).isNotNull()).limit(1).count():
            return df
    except AnalysisException:
        pass
    return None


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``ord``, the position in ``order`` (columns that tell all rows apart), without one task that sees all rows.

    Rows are dealt to ranges and numbered in each; a range's offset is the sum of the counts before it,
    one number per task.
    """
    dealt = materialised(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    offsets, total = [], 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_range").count().collect()):
        offsets.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "_range").withColumn("ord", F.col("_before") + inside).drop("_range", "_before")


def write_list(entries: DataFrame, name: str, version: str, folder: str, shard: int = SHARD_ENTRIES) -> None:
    """Write (ord, entry) rows as a list in shards that ``load_list`` reads."""
    number = F.floor(F.col("ord") / shard).alias("_shard")
    lines = entries.groupBy(number).agg(F.sort_array(F.collect_list(F.struct("ord", "entry"))).alias("e")).select(
        F.to_json(F.struct(
            F.lit(version).alias("version"), F.col("e")[0]["ord"].alias("first"),
            F.transform("e", lambda x: x["entry"]).alias(ENTRY_COLUMN[name]))).alias("value"))
    lines.write.text(f"{folder.rstrip('/')}/{name}.jsonl")


def load_list(spark: SparkSession, name: str, live_dir: str | None = None,
              bundled_dir: str | None = None) -> DataFrame:
    """Entries of a list with their position as ``ord``."""
    df = load_file(spark, name, live_dir, bundled_dir)
    entry = ENTRY_COLUMN[name]
    if name == "keyword_categories":
        return _placed(df, F.map_entries(entry)).select(
            "ord", F.col("e.key").alias("category"), "e.value.*")
    out = _placed(df, F.col(entry))
    if name == "known_bad":
        return out.select("ord", F.lower("e").alias("domain"))
    return out.select("ord", "e.*")


def _placed(df: DataFrame, entries: Column) -> DataFrame:
    """(ord, e): every entry of every document with its position in the list."""
    return df.select("first", F.posexplode(entries).alias("pos", "e")).select(
        (F.coalesce("first", F.lit(0)) + F.col("pos")).cast("int").alias("ord"), "e")


def allow_table(df: DataFrame, **bounds) -> ListTable:
    """Allow-list as a lookup table: lower-cased, last duplicate kept."""
    cols = df.select(
        F.lower("domain").alias("domain"), "name", "official_url",
        F.coalesce("high_value", F.lit(False)).alias("high_value"), "ord",
    )
    return ListTable(last_per_domain(cols), **bounds)


def block_table(df: DataFrame, **bounds) -> ListTable:
    return ListTable(df.select(F.lower("domain").alias("domain")).distinct(), **bounds)


@dataclass(frozen=True)
class Category:
    """One keyword category."""

    name: str
    weight: int | None = None
    cap: int | None = None
    structural: bool = False
    terms: tuple[str, ...] = ()
    terms_fr: tuple[str, ...] = ()
    sin_terms: tuple[str, ...] = ()
    cvv_terms: tuple[str, ...] = ()
    gov_suffixes: tuple[str, ...] = fv.GOV_SUFFIXES


@dataclass(frozen=True)
class Org:
    """One sender organisation."""

    org_id: str
    name: str | None = None
    aliases: tuple[str, ...] = ()
    sending_domains: tuple[str, ...] = ()
    contact_url: str | None = None
    phone: str | None = None


@dataclass(frozen=True)
class Rule:
    """One weighted message rule; ``match`` maps predicate name to argument."""

    rule_id: str
    weight: int
    match: dict = field(default_factory=dict)
    explanation: str | None = None
    explanation_fr: str | None = None


CONFIG_ROWS = 20_000


def _config_rows(df: DataFrame):
    """Rows of a configuration list, in order; refuses to pull a large table."""
    rows = df.orderBy("ord").limit(CONFIG_ROWS + 1).collect()
    if len(rows) > CONFIG_ROWS:
        raise ValueError("configuration list exceeds its size bound")
    return rows


def categories_of(df: DataFrame) -> list[Category]:
    return [
        Category(
            r.category, r.weight, r.cap, bool(r.structural), tuple(r.terms or ()),
            tuple(r.terms_fr or ()), tuple(r.sin_terms or ()), tuple(r.cvv_terms or ()),
            tuple(r.gov_suffixes) if r.gov_suffixes is not None else fv.GOV_SUFFIXES,
        )
        for r in _config_rows(df)
    ]


def orgs_of(df: DataFrame) -> list[Org]:
    return [
        Org(r.id, r.name, tuple(r.aliases or ()), tuple(r.sending_domains or ()),
            r.official_contact_url, r.official_phone)
        for r in _config_rows(df)
    ]


def rules_of(df: DataFrame) -> list[Rule]:
    out = []
    for r in _config_rows(df):
        try:
            match = json.loads(r.match) if r.match else {}
        except ValueError:
            match = {"malformed_match": True}
        out.append(Rule(r.id, r.weight or 0, match, r.user_explanation, r.user_explanation_fr))
    return out


# --- validation -------------------------------------------------------------

def _filled(c: str) -> Column:
    return F.coalesce(F.length(F.col(c)) > 0, F.lit(False))


def _checks(name: str) -> dict[str, Column]:
    """check name -> condition of a bad row."""
    if name == "institutions":
        return {"malformed": ~(_filled("domain") & F.coalesce(F.col("domain").contains("."),
                               F.lit(False)) & _filled("name") & F.col("high_value").isNotNull())}
    if name == "known_bad":
        return {"malformed": ~_filled("domain")}
    if name == "sender_orgs":
        return {"malformed": ~(_filled("id") & _filled("name") & F.col("aliases").isNotNull()
                               & F.col("sending_domains").isNotNull())}
    if name == "rules":
        return {
            "malformed": ~(_filled("id") & F.col("weight").isNotNull()
                           & F.col("match").isNotNull() & _filled("user_explanation")),
            "missing_translation": ~_filled("user_explanation_fr"),
        }
    structural = F.coalesce(F.col("structural"), F.lit(False))
    plain_ok = (F.col("weight").isNotNull() & F.col("terms").isNotNull()
                & F.col("terms_fr").isNotNull())
    structural_ok = (F.col("sin_terms").isNotNull() & F.col("cvv_terms").isNotNull()
                     & F.col("gov_suffixes").isNotNull())
    return {"malformed": ~F.when(structural, structural_ok).otherwise(plain_ok)}


def validate_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """(list_name, check_name, rows, bad_rows), one row per check."""
    parts = []
    for name, df in lists.items():
        for check, bad in _checks(name).items():
            parts.append(df.agg(
                F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_rows"),
            ).select(F.lit(name).alias("list_name"), F.lit(check).alias("check_name"),
                     "rows", "bad_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in one list but not in the other, both ways: (key, side)."""
    a, b = left.select(key), right.select(key)
    return (
        a.subtract(b).withColumn("side", F.lit("left_only"))
        .unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))
    )


# --- refresh ----------------------------------------------------------------

def refresh_plan(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Which lists to replace: both sides are (list_name, version).

    A list is replaced when the incoming version is present and different, not
    only when greater; a missing or failed one leaves the current list alone.
    """
    cur = current.select("list_name", F.col("version").alias("current_version"))
    new = incoming.select("list_name", F.col("version").alias("incoming_version"))
    usable = F.coalesce(F.col("incoming_version") != "", F.lit(False))
    return cur.join(new, "list_name", "full").select(
        "list_name", "current_version", "incoming_version",
        (usable & ~F.col("incoming_version").eqNullSafe(F.col("current_version")))
        .alias("replace"),
    )


def refresh_lists(current: dict[str, DataFrame], incoming: dict[str, DataFrame],
                  out_dir: str) -> list[str]:
    """Write each list whose version changed to a new folder; old data stays.

    Returns the names that were written. A list that fails to read or write is
    skipped.
    """
    spark = next(iter(current.values())).sparkSession
    written = []
    for name, df in incoming.items():
        try:
            new = df.select("version").limit(1).collect()
            cur = current[name].select("version").limit(1).collect() if name in current else []
            new_v = new[0].version if new else None
            cur_v = cur[0].version if cur else None
            if new_v and new_v != cur_v:
                df.write.json(f"{out_dir.rstrip('/')}/{name}/{new_v}")
                written.append(name)
        except Exception as err:  # a bad list must not stop the others
            spark._jvm.org.slf4j.LoggerFactory.getLogger("phishlake").warn(
                f"list {name} skipped: {type(err).__name__}")
    return written


# --- user lists -------------------------------------------------------------

def clean_user_lists(raw: DataFrame) -> DataFrame:
    """Normalise, validate and dedupe (tenant, kind, entry) rows.

    Allow and block lists are deduplicated separately, so a host may be in both.
    """
    return (
        raw.select("tenant", "kind", list_entry(F.col("entry")).alias("domain"))
        .filter(list_entry_is_valid(F.col("domain")))
        .dropDuplicates(["tenant", "kind", "domain"])
    )

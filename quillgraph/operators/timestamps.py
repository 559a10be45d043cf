"""Mixed timestamp notations and zones brought to one instant in UTC.

Raw strings are first reduced to a dictionary of distinct (text, zone, day order); only
the dictionary is parsed, entirely with built-in column expressions, once; it can be kept
as a table and extended with what is new; the instants are then joined back to the rows.

Defined results:
* null, empty and blank text: no row;
* text that names no day, a day that does not exist, an hour beyond 23, an unknown zone
  abbreviation: ``epoch_us`` null (``unreadable``);
* no zone in the text: wall time in the row's zone, UTC where that is null or blank; a
  repeated wall time is the earlier instant, a skipped one moves forward by the gap;
* a day alone: its midnight in that zone;
* digits finer than microseconds are cut off;
* days with slashes and the year last: month first where ``month_first``, else day first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.skew import lookup_join

# Month names and short forms in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr febrero",
    3: "march mar märz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}

# Zone abbreviations and their distance from UTC.
ZONES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "ut": "+00:00", "wet": "+00:00",
    "bst": "+01:00", "west": "+01:00", "cet": "+01:00", "mez": "+01:00", "cest": "+02:00", "mesz": "+02:00",
    "eet": "+02:00", "eest": "+03:00", "msk": "+03:00", "ist": "+05:30", "npt": "+05:45", "jst": "+09:00",
    "kst": "+09:00", "awst": "+08:00", "acst": "+09:30", "acdt": "+10:30", "aest": "+10:00", "aedt": "+11:00",
    "lhst": "+10:30", "lhdt": "+11:00", "nzst": "+12:00", "nzdt": "+13:00", "nst": "-03:30", "ndt": "-02:30",
    "ast": "-04:00", "adt": "-03:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00",
    "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "akst": "-09:00", "akdt": "-08:00", "hst": "-10:00",
}

_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+|^\p{L}+tag,\s+|^(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche),?\s+"
_NAME = "|".join(sorted((n for v in MONTHS.values() for n in v.split()), key=lambda n: (-len(n), n)))
_TAIL = r"(?:,?\s+(?:at\s+|um\s+|à\s+)?(.+))?$"
_ISO = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:(?:t|,?\s+)(.+))?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:(?:t|\s+)(.+))?$"
_NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TAIL
_DAY_NAME = rf"^(\d{{1,2}})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?({_NAME})\.?,?\s+(?:de\s+)?(\d{{4}})" + _TAIL
_NAME_DAY = rf"^({_NAME})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})" + _TAIL
_ZONE = r"((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?"
_CLOCK = r"^(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(am|pm|a\.m\.|p\.m\.|uhr)?\s*" + _ZONE + "$"
_CLOCK_COMPACT = r"^(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*()" + _ZONE + "$"

KEY = ["raw", "zone", "month_first"]


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse_keys(keys: DataFrame) -> DataFrame:
    """``raw, zone, month_first`` with ``epoch_us``: one pass of column expressions, no Python."""
    s = F.lower(F.regexp_replace(F.translate("raw", "−–", "--"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    df = keys.withColumn("__s", F.regexp_replace(s, _WEEKDAY, ""))
    df = df.withColumn("__in", F.regexp_extract("__s", r"\[([^\]]*)\]$", 1)).withColumn("__s", F.regexp_replace("__s", r"\[[^\]]*\]$", ""))
    c = F.col("__s")
    months = _literal_map({n: str(m) for m, v in MONTHS.items() for n in v.split()})
    numeric = F.when((F.regexp_extract(c, _NUMERIC, 2) == "/") & F.col("month_first"), F.regexp_replace(c, _NUMERIC, "$4|$1|$3|$5")).otherwise(F.regexp_replace(c, _NUMERIC, "$4|$3|$1|$5"))
    parts = (
        F.when(c.rlike(_ISO), F.regexp_replace(c, _ISO, "$1|$3|$4|$5"))
        .when(c.rlike(r"^\d{8}$|^\d{8}[t\s]"), F.regexp_replace(c, _COMPACT, "$1|$2|$3|$4"))
        .when(c.rlike(_NUMERIC), numeric)
        .when(c.rlike(_DAY_NAME), F.regexp_replace(c, _DAY_NAME, "$3|$2|$1|$4"))
        .when(c.rlike(_NAME_DAY), F.regexp_replace(c, _NAME_DAY, "$3|$1|$2|$4"))
    )
    df = df.withColumn("__d", F.split(parts, r"\|", 4))
    month = F.expr("__d[1]")
    df = df.withColumn("__m", F.coalesce(F.try_element_at(months, month), month).try_cast("int")).withColumn("__t", F.trim(F.expr("__d[3]")))
    t = F.col("__t")
    clock = F.when(t == "", F.lit("0|0|0|||")).when(t.rlike(_CLOCK), F.regexp_replace(t, _CLOCK, "$1|$2|$3|$4|$5|$6")).when(t.rlike(_CLOCK_COMPACT), F.regexp_replace(t, _CLOCK_COMPACT, "$1|$2|$3|$4|$5|$6"))
    df = df.withColumn("__c", F.split(clock, r"\|", 6))
    hour, half, named = F.expr("__c[0]").try_cast("int"), F.substring(F.expr("__c[4]"), 1, 1), F.expr("__c[5]")
    hour = F.when(half.isin("a", "p"), F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(hour)
    offset = F.regexp_extract(named, r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$", 2)
    given = F.when(
        offset != "",
        F.concat(
            F.regexp_extract(named, r"([+-])", 1),
            F.lpad(offset, 2, "0"),
            F.lit(":"),
            F.rpad(F.regexp_extract(named, r"[+-]\d{1,2}?:?(\d{2})$", 1), 2, "0"),
        ),
    ).otherwise(F.try_element_at(_literal_map(ZONES), named))
    # "+530" style groups are read as hours then minutes, "+01" as hours alone
    given = F.when(named.rlike(r"[+-]\d{1,2}$"), F.concat(F.regexp_extract(named, r"([+-])", 1), F.lpad(offset, 2, "0"), F.lit(":00"))).otherwise(given)
    own = F.when(F.trim(F.coalesce(F.col("zone"), F.lit(""))) == "", F.lit("UTC")).otherwise(F.trim("zone"))
    zone = F.when(named != "", given).when(F.col("__in") != "", F.initcap("__in")).otherwise(own)
    zone = F.when((named == "") & (F.col("__in") != ""), F.regexp_extract("raw", r"\[([^\]]*)\]\s*$", 1)).otherwise(zone)
    second = F.concat(
        F.when(F.expr("__c[2]") == "", "0").otherwise(F.expr("__c[2]")), F.lit("."), F.rpad(F.substring(F.expr("__c[3]"), 1, 6), 6, "0")
    ).try_cast("decimal(16,6)")
    df = df.withColumn("__z", zone).withColumn("__h", hour).withColumn("__sec", second)
    wall = F.expr("unix_micros(try_make_timestamp(try_cast(__d[0] as int), __m, try_cast(__d[2] as int), __h, try_cast(__c[1] as int), CASE WHEN __sec < 60 THEN __sec END, __z))")
    number = F.expr(
        "CASE WHEN __s RLIKE '^-?[0-9]{13}$' THEN try_cast(__s AS bigint) * 1000"
        " WHEN __s RLIKE '^-?[0-9]{1,12}$' THEN try_cast(__s AS bigint) * 1000000"
        r" WHEN __s RLIKE '^-?[0-9]{9,11}\\.[0-9]+$' THEN try_cast(substring_index(__s, '.', 1) AS bigint) * 1000000 + CASE WHEN __s LIKE '-%' THEN -1 ELSE 1 END * cast(rpad(substring(substring_index(__s, '.', -1), 1, 6), 6, '0') AS bigint) END"
    )
    instant = F.when(F.col("__s").rlike(r"^-?\d+(\.\d+)?$") & ~F.col("__s").rlike(r"^\d{8}$"), number).otherwise(wall)
    return df.select(*KEY, instant.alias("epoch_us"))


class InstantDictionary:
    """Distinct raw values with their instants, kept as a table that only ever grows.

    ``extend`` parses the keys that the table lacks and appends them, so a later run
    parses nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        schema = "raw string, zone string, month_first boolean, epoch_us bigint"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def extend(self, keys: DataFrame) -> DataFrame:
        known = self.read()
        fresh = keys.select(*KEY).distinct()
        if known.take(1):
            same = [fresh[k].eqNullSafe(known[k]) for k in KEY]
            fresh = fresh.join(known, same, "left_anti")
            if not fresh.take(1):
                return known
        parse_keys(fresh).write.mode("append").parquet(self.path)
        return self.read()


def long_values(df: DataFrame, key: str, fields: list[str], zone: str, locale: str) -> DataFrame:
    """One row per key, field and non-blank text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields]))
    return (
        df.select(F.col(key), F.trim(F.coalesce(F.col(zone), F.lit(""))).alias("zone"), (F.coalesce(F.col(locale), F.lit("")) == "en_US").alias("month_first"), pairs.alias("__p"))
        .select(key, "__p.field", "__p.raw", "zone", "month_first")
        .filter(F.col("raw").rlike(r"[^\s\p{Z}\p{Cf}]"))
    )


def normalise_instants(df: DataFrame, key: str, fields: list[str], zone: str, locale: str, dictionary: InstantDictionary) -> DataFrame:
    """``key, field, raw, epoch_us`` for every non-blank value; unreadable ones have null.

    Repeated rows give repeated results; other columns of ``df`` are not looked at.
    """
    values = long_values(df, key, fields, zone, locale)
    known = dictionary.extend(values)
    return lookup_join(values, known, KEY, "left").select(key, "field", "raw", "epoch_us")

"""Raw payloads of three device formats as canonical events or dead letters, in column expressions alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.geo import geohash, pinned
from ..schema import KM_PER_MILE, LATE, SUSPECT

_NUM = r"-?\d+(?:\.\d+)?"
_B = rf"^B\|(VH-\d{{6}})\|(\d{{13}})\|({_NUM})\|({_NUM})\|({_NUM})\|([01])\|(\d+)\|({_NUM})\|(\d+)\|({_NUM})$"
_LOCAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
_ID, _STATUS, _OFFSET = r"^VH-[0-9]{6}$", "^0x[0-9A-Fa-f]{2}$", r"^[+-]\d{2}:\d{2}$"
_A_FIELDS = StructType([StructField(*f) for f in (("vehicle_id", StringType()), ("seq", LongType()), ("timestamp", StringType()), ("ignition", BooleanType()))] + [StructField(k, DoubleType()) for k in ("lat", "lon", "speed_kmh", "heading_deg", "battery_v", "odometer_km")])
_C_FIELDS = StructType([
    StructField("dev", StructType([StructField("id", StringType()), StructField("seq", LongType())])), StructField("time", StructType([StructField("local", StringType()), StructField("offset", StringType())])),
    StructField("gps", StructType([StructField("lat_e6", LongType()), StructField("lon_e6", LongType()), StructField("hdg", DoubleType())])), StructField("motion", StructType([StructField("spd_ms", DoubleType())])),
    StructField("power", StructType([StructField("batt_mv", LongType())])), StructField("status", StringType()), StructField("odo_m", LongType()),
])
_SPACE = r"[ \t\n\r\x0b\x0c]"
_MEASURES = ("seq", "device_ts", "lat", "lon", "speed_kmh", "heading_deg", "ignition", "battery_v", "odometer_km")


def sniff_format(payload: Column) -> Column:
    """The format that a payload's first bytes suggest, also of broken ones: A, B, C or unknown."""
    head = F.substring(F.regexp_replace(F.make_valid_utf8(payload.cast("string")), rf"^{_SPACE}+", ""), 1, 16)
    return F.when(head.startswith("B|"), "B").when(head.startswith('{"dev":'), "C").when(head.startswith('{"vehicle_id":'), "A").otherwise("unknown")


class _Json:
    """Typed access to a variant column; the first failing field in order of access gives the reason."""

    def __init__(self, value: Column):
        self.value, self.reasons = value, []

    def field(self, path: str, *kinds: str) -> Column:
        got = F.try_variant_get(self.value, f"$.{path}", "variant")
        kind, name = F.schema_of_variant(got), path.rsplit(".", 1)[-1]
        fits = F.lit(False)
        for k in kinds:
            fits = fits | kind.startswith(k)
        self.reasons.append(F.when(kind.isNull(), f"missing_{name}").when(~fits, f"bad_type_{name}"))
        return got

    def get(self, path: str, kind: str, target: str) -> Column:
        self.field(path, kind)
        return F.try_variant_get(self.value, f"$.{path}", target)

    def number(self, path: str) -> Column:
        self.field(path, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
        return F.try_variant_get(self.value, f"$.{path}", "double")

    def require(self, good: Column, reason: str) -> None:
        self.reasons.append(F.when(~F.coalesce(good, F.lit(False)), reason))

    def reason(self) -> Column:
        return F.coalesce(*self.reasons)


def _epoch(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def _event(vehicle_id: Column, oem: str, **measures: Column) -> Column:
    return F.struct(vehicle_id.alias("vehicle_id"), F.lit(oem).alias("oem"), *[measures[k].alias(k) for k in _MEASURES])


def _format_b(text: Column, part: Column) -> tuple[Column, Column]:
    """``part`` holds the fields of a text that matches the pattern, else null."""
    get = lambda i, kind: part[i].try_cast(kind)
    reason = F.when(part.isNull(), F.when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) != 10, "b_bad_fields").otherwise("b_bad_values"))
    event = _event(
        part[1], "B", seq=get(7, "long"), device_ts=get(2, "long") / 1000, lat=get(3, "double"), lon=get(4, "double"),
        speed_kmh=get(5, "double") * KM_PER_MILE, heading_deg=F.pmod(get(8, "double"), F.lit(360.0)), ignition=part[6] == "1",
        battery_v=get(9, "long") / 1000, odometer_km=get(10, "double") * KM_PER_MILE,
    )
    return reason, event


def _event_a(get, at: Column) -> Column:
    return _event(
        get("vehicle_id"), "A", seq=get("seq"), device_ts=at, lat=get("lat"), lon=get("lon"), speed_kmh=get("speed_kmh"), heading_deg=F.pmod(get("heading_deg"), F.lit(360.0)),
        ignition=get("ignition"), battery_v=get("battery_v"), odometer_km=get("odometer_km"),
    )


def _event_c(get, at: Column) -> Column:
    return _event(
        get("dev.id"), "C", seq=get("dev.seq"), device_ts=at, lat=get("gps.lat_e6") / 1e6, lon=get("gps.lon_e6") / 1e6, speed_kmh=get("motion.spd_ms") * 3.6, heading_deg=F.pmod(get("gps.hdg"), F.lit(360.0)),
        ignition=F.conv(F.substring(get("status"), 3, 2), 16, 10).try_cast("int").bitwiseAND(1) == 1, battery_v=get("power.batt_mv") / 1000, odometer_km=get("odo_m") / 1000,
    )


def _format_a(parsed: Column) -> tuple[Column, Column]:
    j, got = _Json(parsed), {}
    stamp = j.get("timestamp", "STRING", "string")
    j.require(stamp.rlike(_UTC) & _epoch(stamp).isNotNull(), "a_bad_timestamp")
    got["vehicle_id"] = j.get("vehicle_id", "STRING", "string")
    j.require(got["vehicle_id"].rlike(_ID), "bad_vehicle_id")
    got["seq"] = j.get("seq", "BIGINT", "long")
    got |= {k: j.number(k) for k in ("lat", "lon", "speed_kmh", "heading_deg")}
    got["ignition"] = j.get("ignition", "BOOLEAN", "boolean")
    got |= {k: j.number(k) for k in ("battery_v", "odometer_km")}
    return j.reason(), _event_a(got.__getitem__, _epoch(stamp))


def _format_c(parsed: Column) -> tuple[Column, Column]:
    j, got = _Json(parsed), {}
    for part in ("dev", "time", "gps"):
        j.field(part, "OBJECT")
    local, offset = j.get("time.local", "STRING", "string"), j.get("time.offset", "STRING", "string")
    at = _epoch(F.concat(local, offset))
    j.require(local.rlike(_LOCAL) & offset.rlike(_OFFSET) & at.isNotNull(), "c_bad_time")
    got["status"] = j.get("status", "STRING", "string")
    j.require(got["status"].rlike(_STATUS), "c_bad_status_hex")
    got["dev.id"] = j.get("dev.id", "STRING", "string")
    j.require(got["dev.id"].rlike(_ID), "bad_vehicle_id")
    got |= {k: j.get(k, "BIGINT", "long") for k in ("dev.seq", "gps.lat_e6", "gps.lon_e6")}
    j.field("motion", "OBJECT")
    got |= {k: j.number(k) for k in ("motion.spd_ms", "gps.hdg")}
    j.field("power", "OBJECT")
    got |= {k: j.get(k, "BIGINT", "long") for k in ("power.batt_mv", "odo_m")}
    return j.reason(), _event_c(got.__getitem__, at)


def _plain(parsed: Column, schema: StructType) -> Column:
    """Whether a typed parse found every field of the schema."""
    good = parsed.isNotNull()
    for f in schema.fields:
        value = parsed[f.name]
        good = good & (_plain(value, f.dataType) if isinstance(f.dataType, StructType) else value.isNotNull())
    return good


def event_id(vehicle_id: Column, device_ts: Column, seq: Column) -> Column:
    """The same id for every copy of one reading."""
    return F.substring(F.sha1(F.concat_ws("|", vehicle_id, F.bround(device_ts * 1000).cast("long").cast("string"), seq.cast("string")).cast("binary")), 1, 20)


def normalise(raw: DataFrame) -> DataFrame:
    """payload, ingest_ts and offset with ``format``, ``reason`` (null if good) and ``event``, a canonical event's fields.

    A payload whose typed parse has every field in its right form is good. Only the others are looked at field by field, for
    the first reason. A text is valid JSON if it parses as a variant, which accepts no key twice and no NaN.
    """
    text = F.regexp_replace(F.make_valid_utf8(F.col("payload").cast("string")), r"(?U)^\s+|\s+$", "")
    shaped = pinned(raw, format=sniff_format(F.col("payload")), _text=text)
    shape = F.when(~F.is_valid_utf8(F.col("payload").cast("string")), "bad_encoding").when(F.col("_text").rlike(r"^B\|"), "B")
    shape = shape.when(F.col("_text").startswith('{"dev":'), "C").when(F.col("_text").startswith('{"vehicle_id":'), "A").otherwise("unknown_format")
    of, strict = F.col("_shape"), {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    shaped = pinned(shaped, _shape=shape)
    shaped = pinned(
        shaped, _json=F.when(of.isin("A", "C"), F.try_parse_json("_text")), _b=F.when((of == "B") & F.col("_text").rlike(_B), F.split("_text", r"\|")),
        _a=F.when(of == "A", F.from_json("_text", _A_FIELDS, strict)), _c=F.when(of == "C", F.from_json("_text", _C_FIELDS, strict)),
    )
    a, c = F.col("_a"), F.col("_c")
    shaped = pinned(shaped, _at=F.when(a["timestamp"].rlike(_UTC), _epoch(a["timestamp"])).when(c["time"]["local"].rlike(_LOCAL) & c["time"]["offset"].rlike(_OFFSET), _epoch(F.concat(c["time"]["local"], c["time"]["offset"]))))
    parses, at = F.col("_json").isNotNull(), F.col("_at")
    plain_a = parses & _plain(a, _A_FIELDS) & at.isNotNull() & a["vehicle_id"].rlike(_ID)
    plain_c = parses & _plain(c, _C_FIELDS) & at.isNotNull() & c["dev"]["id"].rlike(_ID) & c["status"].rlike(_STATUS)
    shaped = pinned(shaped, _plain=F.coalesce(F.when(of == "A", plain_a).when(of == "C", plain_c), F.lit(False)))
    (b_reason, b), (a_reason, a_event), (c_reason, c_event) = _format_b(F.col("_text"), F.col("_b")), _format_a(F.col("_json")), _format_c(F.col("_json"))
    is_object = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    in_ = lambda parsed: lambda path: functools.reduce(lambda x, name: x[name], path.split("."), parsed)
    reason = F.when(F.col("_plain"), F.lit(None)).when(of.isin("bad_encoding", "unknown_format"), of).when(of == "B", b_reason).when(~is_object, "bad_json").when(of == "A", a_reason).otherwise(c_reason)
    event = F.when(of == "B", b).when(F.col("_plain"), F.when(of == "A", _event_a(in_(a), at)).otherwise(_event_c(in_(c), at))).when(of == "A", a_event).when(of == "C", c_event)
    parsed = pinned(shaped, _reason=reason, _e=event).select(*raw.columns, "format", "_reason", "_e")
    e = F.col("_e")
    ranged = F.when(~(e["lat"].between(-90, 90) & e["lon"].between(-180, 180)), "gps_out_of_range").when(~((e["speed_kmh"] >= 0) & (e["speed_kmh"] < 400)), "speed_out_of_range").when(e["seq"] < 0, "bad_seq")
    full = F.struct(
        event_id(e["vehicle_id"], e["device_ts"], e["seq"]).alias("event_id"), e["vehicle_id"].alias("vehicle_id"), e["oem"].alias("oem"), e["seq"].alias("seq"), e["device_ts"].alias("device_ts"),
        F.col("ingest_ts").alias("ingest_ts"), e["lat"].alias("lat"), e["lon"].alias("lon"), geohash(e["lat"], e["lon"], 7).alias("geohash"), e["speed_kmh"].alias("speed_kmh"),
        e["heading_deg"].alias("heading_deg"), e["ignition"].alias("ignition"), e["battery_v"].alias("battery_v"), e["odometer_km"].alias("odometer_km"), F.array().cast("array<string>").alias("flags"),
    )
    judged = pinned(parsed, reason=F.coalesce("_reason", ranged))
    return pinned(judged, event=F.when(F.col("reason").isNull(), full)).select(*raw.columns, "format", "reason", "event")


def events(normalised: DataFrame) -> DataFrame:
    """The good rows as canonical events with their arrival ``offset``."""
    return normalised.where("reason IS NULL").select("event.*", "offset")


def dead_letters(normalised: DataFrame) -> DataFrame:
    """The bad rows as JSON with reason, payload (bad bytes replaced) and ingest_ts."""
    letter = F.struct("reason", F.make_valid_utf8(F.col("payload").cast("string")).alias("payload"), "ingest_ts")
    return normalised.where("reason IS NOT NULL").select("offset", F.to_json(letter).alias("letter"))


def counters(normalised: DataFrame) -> DataFrame:
    """Counts by name: all rows, each format, dead letters by reason and format, and normalised rows by format."""
    dead = F.col("reason").isNotNull()
    names = F.array_compact(F.array(
        F.lit("in"), F.concat(F.lit("in."), F.col("format")), F.when(dead, F.lit("dead_letter")), F.when(dead, F.concat(F.lit("dead_letter."), F.col("reason"))),
        F.when(dead, F.concat(F.lit("dead_letter.oem."), F.col("format"))), F.when(~dead, F.lit("parsed")), F.when(~dead, F.concat(F.lit("parsed."), F.col("format"))),
    ))
    return normalised.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def sampled(raw: DataFrame, every: int = 500) -> DataFrame:
    """Every ``every``-th row in order of offset."""
    from .numbering import numbered

    return numbered(raw, "offset").where(F.col("row_no") % every == 0).drop("row_no")


def as_samples(normalised: DataFrame) -> DataFrame:
    """Payloads cut to 400 characters, with what became of them at parsing."""
    raw = F.substring(F.make_valid_utf8(F.col("payload").cast("string")), 1, 400)
    return normalised.select("offset", F.col("format").alias("oem"), raw.alias("raw"), F.when(F.col("reason").isNull(), "parsed").otherwise("dead_letter").alias("outcome"), F.coalesce("reason", F.lit("")).alias("detail"))


def samples(normalised: DataFrame, every: int = 500) -> DataFrame:
    """``as_samples`` of every ``every``-th payload. Parsing keeps every row, so raw rows may as well be ``sampled`` before it."""
    return as_samples(sampled(normalised.select("offset", "payload", "format", "reason"), every))


def sample_outcomes(normalised: DataFrame, cleaned: DataFrame, every: int = 500) -> DataFrame:
    """The payloads that ``samples`` takes, followed to their end: dead_letter, duplicate, late, flagged or clean."""
    fate = cleaned.select("offset", F.when(F.col("outcome") == LATE, "late").when(F.array_contains("flags", SUSPECT), "flagged").otherwise("clean").alias("_fate"))
    followed = samples(normalised, every).join(fate, "offset", "left")
    return followed.withColumn("outcome", F.when(F.col("outcome") == "dead_letter", F.col("outcome")).otherwise(F.coalesce("_fate", F.lit("duplicate")))).drop("_fate")

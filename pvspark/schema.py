"""Canonical hourly schema: field names, requirement, units and ranges.

Fixed values (must equal the reference data contract):
  timestamp            required  UTC datetime
  site_id              required  string
  ac_energy_kwh        required  float  kWh   >= 0
  ghi_w_m2             required  float  W/m²  >= 0
  ambient_temperature_c required float  °C
  cloud_cover_pct      required  float  %     0..100
  relative_humidity_pct required float  %     0..100
  wind_speed_m_s       required  float  m/s   >= 0
  dni_w_m2             optional  float  W/m²  >= 0
  dhi_w_m2             optional  float  W/m²  >= 0
  module_temperature_c optional  float  °C
  precipitation_mm     optional  float  mm    >= 0
  inverter_availability_pct optional float % 0..100
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    required: bool
    kind: str  # "timestamp" | "string" | "float"
    unit: str | None
    minimum: float | None = None
    maximum: float | None = None


# Canonical field definitions in canonical order.
FIELDS: tuple[Field, ...] = (
    Field("timestamp", True, "timestamp", None),
    Field("site_id", True, "string", None),
    Field("ac_energy_kwh", True, "float", "kWh", 0, None),
    Field("ghi_w_m2", True, "float", "W/m²", 0, None),
    Field("ambient_temperature_c", True, "float", "°C"),
    Field("cloud_cover_pct", True, "float", "%", 0, 100),
    Field("relative_humidity_pct", True, "float", "%", 0, 100),
    Field("wind_speed_m_s", True, "float", "m/s", 0, None),
    Field("dni_w_m2", False, "float", "W/m²", 0, None),
    Field("dhi_w_m2", False, "float", "W/m²", 0, None),
    Field("module_temperature_c", False, "float", "°C"),
    Field("precipitation_mm", False, "float", "mm", 0, None),
    Field("inverter_availability_pct", False, "float", "%", 0, 100),
)

FIELD_BY_NAME = {f.name: f for f in FIELDS}
REQUIRED = tuple(f.name for f in FIELDS if f.required)
OPTIONAL = tuple(f.name for f in FIELDS if not f.required)
CANONICAL = REQUIRED + OPTIONAL
NUMERIC = tuple(f.name for f in FIELDS if f.kind == "float")
KEYS = ("site_id", "timestamp")
TARGET = "ac_energy_kwh"
# Required weather inputs, in schema order (eligibility reasons follow it).
REQUIRED_WEATHER = tuple(c for c in REQUIRED if c not in ("timestamp", "site_id", TARGET))

# Weather descriptives / correlation order (fixed values).
WEATHER_COLUMNS = (
    "ghi_w_m2",
    "dni_w_m2",
    "dhi_w_m2",
    "ambient_temperature_c",
    "module_temperature_c",
    "cloud_cover_pct",
    "relative_humidity_pct",
    "wind_speed_m_s",
    "precipitation_mm",
    "inverter_availability_pct",
)

# Weather-only table columns (generation comes separately); all required there.
WEATHER_TABLE_COLUMNS = (
    "timestamp",
    "site_id",
    "ambient_temperature_c",
    "relative_humidity_pct",
    "precipitation_mm",
    "cloud_cover_pct",
    "wind_speed_m_s",
    "ghi_w_m2",
    "dni_w_m2",
    "dhi_w_m2",
)
GENERATION_COLUMNS = ("timestamp", "site_id", "ac_energy_kwh")

# Site dimension fields (fixed values).
SITE_FIELDS = (
    "site_id",
    "latitude",
    "longitude",
    "timezone",
    "installed_capacity_kwp",
    "panel_tilt_degrees",
    "panel_azimuth_degrees",
)

HOUR_US = 3_600_000_000  # microseconds per hour


def canonical_struct(optional: tuple[str, ...] = OPTIONAL) -> T.StructType:
    fields = []
    for name in REQUIRED + tuple(optional):
        f = FIELD_BY_NAME[name]
        dtype = {"timestamp": T.TimestampType(), "string": T.StringType()}.get(f.kind, T.DoubleType())
        fields.append(T.StructField(name, dtype, not f.required))
    return T.StructType(fields)

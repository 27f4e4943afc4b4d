"""Constants and table schemas shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the change-detection rules.
DB_FLOOR = 1e-6
FLOOD_THRESHOLD_DB = -5.5
OTSU_ACCEPT_BELOW_DB = -3.0
OTSU_BINS = 256
LABEL_NODATA = -9999
DEFAULT_TILE = 1024


@dataclass(frozen=True)
class Affine:
    """North-up affine of a raster: pixel (y, x) has its corner at (x0 + x*a, y0 + y*e)."""

    x0: float
    a: float
    y0: float
    e: float


@dataclass(frozen=True)
class Header:
    """Raster metadata. ``height`` may be a number or a scalar-subquery Column."""

    width: int
    height: object
    affine: Affine
    crs: str = "EPSG:4326"
    nodata: float = 0.0


TILE_RESULT = T.StructType(
    [
        T.StructField("tile_id", T.LongType()),
        T.StructField("pixel_count", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

SCENE_CATALOGUE = T.StructType(
    [
        T.StructField("scene_id", T.LongType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("scene_name", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

EVENT_TARGET = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("match_id", T.LongType()),
    ]
)

# Shape of one nested match document (see sources.documents).
MATCH_DOC = (
    "info struct<match_id:bigint,dates:array<string>,teams:array<string>,venue:string,"
    "outcome:struct<winner:string,margin:struct<runs:bigint,detail:struct<name:string>>>,"
    "players:map<string,array<string>>>,"
    "innings array<struct<team:string,overs:array<struct<over:int,deliveries:array<struct<"
    "batter:string,bowler:string,runs:struct<batter:bigint,total:bigint>,"
    "wickets:array<struct<kind:string,player_out:string>>>>>>>>"
)

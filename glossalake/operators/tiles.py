"""Vector tiles of points: one blob for each tile, all tiles of a zoom level in one pass."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import in_tile

#: A tile's grid, and how far beyond it a point is kept.
EXTENT, BUFFER = 4096, 256


def one_tile(points: DataFrame, bounds: tuple[float, float, float, float], layer: str, drop: Sequence[str] = ("Latitude", "Longitude")) -> DataFrame:
    """(tile): the blob of the points within bounds (west, south, east, north), edges included. No points give one tile without features."""
    w, s, e, n = bounds
    rows = in_tile(points, w, s, e, n).withColumns({"layer": F.lit(layer), "z": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    found = encoded(rows, drop).select("tile")
    empty = points.sparkSession.createDataFrame([(bytearray(b""),)], "tile binary")
    return empty.join(found.select(F.col("tile").alias("t")), F.lit(True), "left").select(F.coalesce("t", "tile").alias("tile"))  # one row each


def tiles(points: DataFrame, zoom: int, layer: str, buffer: int = BUFFER, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """(z, x, y, tile) of every tile of a zoom level that has points in it or within `buffer` grid steps of it. Points without valid numbers, or beyond the map, are left out."""
    n = float(1 << zoom)
    p = points.withColumns({"p_la": F.col(lat).try_cast("double"), "p_lo": F.col(lon).try_cast("double")}).filter("abs(p_la) < 85.0511D AND p_lo >= -180D AND p_lo < 180D")
    fx = (F.col("p_lo") + 180.0) / 360.0 * n
    fy = (1.0 - F.log(F.tan(F.radians(45.0 + F.col("p_la") / 2.0))) / F.pi()) / 2.0 * n
    near = buffer / EXTENT
    at = lambda f: F.sequence(F.greatest(F.floor(f - near), F.lit(0)), F.least(F.floor(f + near), F.lit((1 << zoom) - 1)))
    dealt = p.withColumns({"p_x": fx, "p_y": fy}).withColumn("x", F.explode(at(F.col("p_x")))).withColumn("y", F.explode(at(F.col("p_y"))))
    rows = dealt.withColumns({"z": F.lit(zoom), "layer": F.lit(layer), "gx": F.floor((F.col("p_x") - F.col("x")) * EXTENT).cast("int"), "gy": F.floor((F.col("p_y") - F.col("y")) * EXTENT).cast("int")})
    return encoded(rows.drop("p_la", "p_lo", "p_x", "p_y"), (lat, lon))


def encoded(rows: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """(z, x, y, tile). rows: layer, z, x, y, gx, gy and the features' properties, less those to drop.

    Features are encoded where they are, into bytes; a tile only strings its features together with the keys and values that they name.
    """
    names = [c for c in rows.columns if c not in {"layer", "z", "x", "y", "gx", "gy", *drop}]
    encode = _encoder()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        blob = encode(part["layer"].iloc[0], names, part[["gx", "gy", *names]].itertuples(index=False, name=None))
        return pd.DataFrame({"z": [key[0]], "x": [key[1]], "y": [key[2]], "tile": [blob]})

    some = rows.select("layer", *[F.col(c).cast("long").alias(c) for c in ("z", "x", "y")], "gx", "gy", *names)
    return some.groupBy("z", "x", "y").applyInPandas(run, "z long, x long, y long, tile binary")


def _encoder():
    """A function made here goes to the workers by value: they need not have this package."""

    def number(n: int) -> bytes:
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    def field(i: int, body: bytes) -> bytes:
        return number(i << 3 | 2) + number(len(body)) + body

    def value(v) -> bytes:
        if isinstance(v, bool):
            return number(7 << 3) + number(int(v))
        if isinstance(v, int):
            return number(6 << 3) + number(v * 2 if v >= 0 else -v * 2 - 1)
        if isinstance(v, float):
            return number(3 << 3 | 1) + struct.pack("<d", v)
        return field(1, str(v).encode())

    def encode(layer: str, names: Sequence[str], rows: Iterator[tuple]) -> bytes:
        """A tile of one layer of points (gx, gy, properties); nulls have no property."""
        values: dict[tuple, int] = {}
        features = []
        for gx, gy, *props in rows:
            tags = b""
            for k, v in enumerate(props):
                v = v.item() if hasattr(v, "item") else v
                if v is None or v != v:
                    continue
                tags += number(k) + number(values.setdefault((type(v).__name__, v if isinstance(v, (bool, int, float)) else str(v)), len(values)))
            moves = number(9) + b"".join(number(d * 2 if d >= 0 else -d * 2 - 1) for d in (int(gx), int(gy)))
            features.append(field(2, field(2, tags) + number(3 << 3) + number(1) + field(4, moves)))
        body = number(15 << 3) + number(2) + field(1, layer.encode()) + b"".join(features)
        body += b"".join(field(3, n.encode()) for n in names) + b"".join(field(4, value(v)) for _, v in values) + number(5 << 3) + number(4096)
        return field(3, body)

    return encode

"""Coordinate proximity joins (O-JOIN5) and near-duplicate inserts (O-CHG5).

``abs(a.lat-b.lat) < tol AND abs(a.lon-b.lon) < tol`` has no equality, so
Catalyst would plan it as a nested-loop join. Instead both sides are binned
on a ``tol``-sized grid: two points within ``tol`` on both axes lie in the
same or adjacent cells, so one side explodes into its 3x3 neighbourhood and
the join is an equi-join on the cell (dense cells are split by
``pairs.keyed_pairs``), followed by the exact predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import keyed_pairs


def _cell(c: Column, tol: float) -> Column:
    return F.floor(c / F.lit(tol)).cast("long")


def near_join(a: DataFrame, b: DataFrame, tol: float, lat: str = "latitude",
              lon: str = "longitude", lprefix: str = "l_", rprefix: str = "r_") -> DataFrame:
    """All (a, b) pairs with |dlat| < tol and |dlon| < tol, columns prefixed."""
    def cell(dy: int = 0, dx: int = 0) -> Column:
        return F.concat_ws(":", _cell(F.col(lat), tol) + dy, _cell(F.col(lon), tol) + dx)

    here = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    around = F.array(*[cell(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    # one cell per left row, so a pair meets once; a dense cell is dealt into a grid
    j = keyed_pairs(a.where(here).withColumn("_cells", F.array(cell())),
                    b.where(here).withColumn("_cells", around), "_cells", "_cells", lprefix, rprefix)
    cond = (F.abs(F.col(lprefix + lat) - F.col(rprefix + lat)) < tol) & \
           (F.abs(F.col(lprefix + lon) - F.col(rprefix + lon)) < tol)
    return j.where(cond).drop("block_key", lprefix + "_cells", rprefix + "_cells")


def insert_if_not_near(base: DataFrame, new: DataFrame, tol: float = 0.001, key: str = "id",
                       order_col: str = "pos", lat: str = "latitude",
                       lon: str = "longitude") -> DataFrame:
    """O-CHG5 outcome per new row: ``rejected`` (no coordinates, or a
    coordinate of exactly 0 like the reference's ``not lat``), ``existing``
    (an existing row is near: its smallest key is returned) or ``inserted``.

    New rows are also checked against each other in arrival order (a row
    near an earlier inserted one becomes a duplicate of it): that is the
    sequential rule of O-DED2 applied to the rows not matched to the base.
    """
    from .dedupe import dedupe_near

    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(lat) != 0) & (F.col(lon) != 0)
    rejected = new.where(~ok).select(F.col(order_col), F.lit("rejected").alias("outcome"),
                                     F.lit(None).cast(base.schema[key].dataType).alias("existing_id"))
    cand = new.where(ok)
    hits = near_join(cand.select(order_col, lat, lon), base.select(key, lat, lon), tol,
                     lat, lon, "n_", "b_")
    nearest = hits.groupBy(F.col("n_" + order_col).alias(order_col)).agg(
        F.min("b_" + key).alias("existing_id"))
    existing = nearest.select(order_col, F.lit("existing").alias("outcome"), "existing_id")
    fresh = cand.join(nearest.select(order_col), order_col, "left_anti")
    groups = dedupe_near(fresh.select(order_col, lat, lon), tol, order_col=order_col, lat=lat,
                         lon=lon)
    dup = groups.select(F.col(order_col),
                        F.when(F.col("leader") == F.col(order_col), F.lit("inserted"))
                        .otherwise(F.lit("duplicate of new row")).alias("outcome"),
                        F.lit(None).cast(base.schema[key].dataType).alias("existing_id"))
    return rejected.unionByName(existing).unionByName(dup)

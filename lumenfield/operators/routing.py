"""One catalogue from two branches: joint fits where an image is crowded, conservative detections elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rounds
from . import spatial as S
from .shared import settle


def measured(flux: str = "flux") -> Column:
    """Whether a fit gave a place and a finite flux above zero."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return finite("x") & finite("y") & finite(flux) & (F.col(flux) > 0)


def merge(proposals: DataFrame, fits: DataFrame, conservative: DataFrame, *, reach: float = 10.0, dense: int = 3, radius: float = 2.0, duplicate: float = 1.0) -> DataFrame:
    """field_id, det_id, x, y, flux and ``route``: joint, fallback or conservative.

    Proposals with ``dense`` others within ``reach`` take their joint fit (``fits``: the proposal's id, and place and flux as
    fitted).  A conservative detection stays where its nearest proposal within ``radius`` (or, without one, the proposals around) is not
    crowded, and as the fallback where it is and that proposal has no usable fit.  Of entries up to ``duplicate`` apart the joint ones
    come first, then fallbacks, then conservative ones, by id within each: rounds of ``thin``.

    Defined results: unusable rows of either branch, and rows with a null field or id, do not enter; a field without joint fits keeps its conservative
    detections, and one without those its joint fits; proposals and fits that repeat an id count as one, the first by flux; an empty input gives no row of its
    route; other columns take no part."""
    spots = proposals.where("field_id is not null and det_id is not null").groupBy("field_id", "det_id").agg(F.min(F.struct("x", "y")).alias("at")).select("field_id", "det_id", "at.x", "at.y")
    fitted = fits.where(measured() & F.col("field_id").isNotNull() & F.col("det_id").isNotNull()).groupBy("field_id", "det_id").agg(F.max(F.struct("flux", "x", "y")).alias("f")).select("field_id", "det_id", "f.x", "f.y", "f.flux")
    keys = ["field_id", "det_id"]
    counted = settle(S.neighbour_counts(spots, spots, {"around": reach}, point_id="det_id", other_id="det_id").join(fitted.select(*keys, F.lit(True).alias("has_fit")).hint("merge"), keys, "left"))
    joint = fitted.join(counted.where(F.col("around") >= dense).select(*keys).hint("merge"), keys, "left_semi")

    usable = conservative.where(measured() & F.col("field_id").isNotNull() & F.col("det_id").isNotNull()).select(*keys, "x", "y", "flux")
    # one pass over pairs tells the nearest proposal as well as how many are around
    spot = counted.select("field_id", F.col("det_id").alias("spot"), "x", "y", "around", F.coalesce("has_fit", F.lit(False)).alias("has_fit"))
    met = S.pairs_within(usable.select(*keys, "x", "y"), spot, max(reach, radius))
    close = F.when(F.col("d2") <= radius * radius, F.struct("d2", "spot", "around", "has_fit"))
    told = met.groupBy(*keys).agg(F.min(close).alias("near"), F.count_if(F.col("d2") <= reach * reach).alias("direct"))
    routed = usable.join(told.hint("merge"), keys, "left")
    routed = routed.withColumns({"crowded": F.coalesce("near.around", "direct", F.lit(0)) >= dense, "has_fit": F.col("near.has_fit")})  # no proposal near, no fallback

    names = ("field_id", "det_id", "x", "y", "flux")
    branch = F.when(F.col("crowded") & ~F.col("has_fit"), 1).when(~F.col("crowded"), 2)
    entries = joint.select(*names, F.lit(0).alias("branch")).union(routed.withColumn("branch", branch).where("branch is not null").select(*names, "branch"))
    # Ids of the two tables may be the same, so that an entry is named by both.
    entries = settle(entries.withColumn("entry", F.struct("branch", "det_id")))
    kept = rounds.thin(entries, duplicate, point_id="entry", order="branch", inclusive=True)
    return kept.select(*names, F.element_at(F.array(F.lit("joint"), F.lit("fallback"), F.lit("conservative")), F.col("branch") + 1).alias("route"))

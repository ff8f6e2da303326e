"""Catalogues, trials and an image derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Derived tables in terms of the raw ones and of each other.  Integer hashes only; 1e3-style literals are doubles.
SQL: dict[str, str] = {
    "refs": """
select cast(floor(o_orderkey/15e2) as bigint) as field_id, o_orderkey as ref_id,
       (case when o_orderkey%2=0 then 1e2+((o_orderkey%97)*7919%1000)+((o_orderkey*104729)%30000)/1e3 else ((o_orderkey*o_orderkey*31+o_orderkey*7919+104729)%1200000)/1e3 end) as x,
       (case when o_orderkey%2=0 then 1e2+((o_orderkey%97)*6367%1000)+((o_orderkey*49979687)%30000)/1e3 else ((o_orderkey*o_orderkey*17+o_orderkey*32452843+49979687)%1200000)/1e3 end) as y,
       16e0+((o_orderkey*613+o_custkey*7)%8000)/1e3 as mag,
       ((o_orderkey*37)%200)/1e3 as err, ((o_orderkey*53)%500)/1e3 as qfit,
       ((o_orderkey*71)%1500)/1e3 as oth, (o_orderkey*11)%4 as nv
from orders""",
    "dets": """
select cast(floor(l_orderkey/15e2) as bigint) as field_id,
       ((l_orderkey*1000000+l_partkey)*10000+l_suppkey)*8+l_linenumber as det_id,
       (case when l_orderkey%2=0 then 1e2+((l_orderkey%97)*7919%1000)+((l_orderkey*104729)%30000)/1e3 else ((l_orderkey*l_orderkey*31+l_orderkey*7919+104729)%1200000)/1e3 end)
         + ((l_partkey*31+l_linenumber*17)%6001-3000)/1e3 as x,
       (case when l_orderkey%2=0 then 1e2+((l_orderkey%97)*6367%1000)+((l_orderkey*49979687)%30000)/1e3 else ((l_orderkey*l_orderkey*17+l_orderkey*32452843+49979687)%1200000)/1e3 end)
         + ((l_partkey*53+l_suppkey*29)%6001-3000)/1e3 as y,
       1e1+((l_partkey*11+l_suppkey*7+l_orderkey)%100000)/1e1 as flux,
       ((l_partkey*13+l_linenumber)%7000)/1e3 as psf_fit_quality,
       (l_partkey+l_suppkey)%5=0 as deblend_flag
from (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem) t""",
    "scored": """
select field_id, det_id, case when det_id%3=0 then 1 else 0 end as label,
       ((det_id%701)+case when det_id%3=0 then 299 else 0 end)/1e3 as score
from dets""",
    "trials": """
select o_orderkey as trial_id, m.method_no, case when o_orderkey%2=0 then 'low' else 'high' end as density_band,
       case when o_custkey%2=0 then 245e-1 else 265e-1 end as input_mag, 1+o_orderkey%2 as extension,
       case when (o_orderkey*17+m.method_no*5)%23=0 then 'excluded_preexisting' else 'eligible' end as status,
       case when (o_orderkey*17+m.method_no*5)%23=0 then null
            else (o_orderkey*7919+m.method_no*104729)%100 < 40+10*m.method_no end as recovered,
       ((o_orderkey*31+m.method_no*7)%2500)/1e3 as nearest_px,
       ((o_orderkey*13+m.method_no*3)%900)/1e2 as runtime_s
from orders cross join (select n_nationkey as method_no from nation where n_nationkey < 5) m""",
    "method_runs": """
select s_suppkey as field_no, n_nationkey as method_no, (s_suppkey*31+n_nationkey*17)%100/1e2 as recovery,
       case when (s_suppkey+n_nationkey)%6=0 then null else ((s_suppkey*7+n_nationkey*3)%500)/1e2 end as astrometric_rms_mas,
       ((s_suppkey*11+n_nationkey*29)%9000)/1e2 as runtime_s_per_mpix, 50+(s_suppkey*13)%200 as test_references
from supplier cross join nation where n_nationkey < 5 and (s_suppkey*3+n_nationkey)%7 <> 0""",
    "pixels": """
select g.field_id, g.px, g.py,
       case when (g.px*7+g.py*13)%997=0 and g.px>0 then -999e0 else 1e2+g.px/2e1+((g.px*31+g.py*17)%100)/1e2+coalesce(m.v,0e0) end as v
from (select field_id, px, {Y} as py from (select field_id, {X} as px from (select distinct field_id from refs) f) h) g
left join (select field_id, px, py, sum(f*exp(-((px-x)*(px-x)+(py-y)*(py-y))/288e-2)/9.04778684e0) as v
           from (select field_id, x, y, f, px, {SY} as py from (select field_id, x, y, power(1e1, -4e-1*(mag-25e0)) as f, {SX} as px from refs where x<206e0 and y<206e0) s) n
           group by field_id, px, py) m on g.field_id=m.field_id and g.px=m.px and g.py=m.py""",
}
#: Whole numbers from a to b as rows, in either engine.
_RANGES = {
    "spark": lambda a, b: f"explode(sequence(cast({a} as bigint), cast({b} as bigint)))",
    "duckdb": lambda a, b: f"unnest(range(cast({a} as bigint), cast({b} as bigint) + 1))",
}


def text_of(name: str, engine: str) -> str:
    """The SQL of a derived table.  Each field has an image of 200 x 200 pixels; a star shines on those within 6 of it."""
    rows, text = _RANGES[engine], SQL[name]
    for mark, value in {"{X}": rows("0", "199"), "{Y}": rows("0", "199"), "{SX}": rows("ceil(x-6e0)", "floor(x+6e0)"), "{SY}": rows("ceil(y-6e0)", "floor(y+6e0)")}.items():
        text = text.replace(mark, value)
    return text


#: The order in which they can be defined, and what each one needs.
NEEDS: dict[str, tuple[str, ...]] = {"refs": (), "dets": (), "scored": ("dets",), "trials": (), "method_runs": (), "pixels": ("refs",)}


def ctes(*names: str) -> str:
    """``WITH`` clause for DuckDB that defines the named tables and what they need."""
    wanted = set(names)
    for n in reversed(list(NEEDS)):
        if n in wanted:
            wanted |= set(NEEDS[n])
    return "WITH " + ",\n".join(f"{n} AS ({text_of(n, 'duckdb')})" for n in NEEDS if n in wanted)


def pixels_of(refs: DataFrame) -> DataFrame:
    """The rows of ``pixels``, made where the stars of their field lie, so that no pixel is shuffled: all rows of a field share a
    partition, and what goes by field or finer needs no exchange.

    A static plan would also take rows that ``explode`` makes for as few as it starts from, and broadcast them for a join."""
    lit = (F.col("x") < 206.0) & (F.col("y") < 206.0) & F.col("field_id").isNotNull() & F.col("mag").isNotNull()
    ends = [f(F.col(c) + r).alias(f"{c}{i}") for c in "xy" for i, (f, r) in enumerate(((F.ceil, -6.0), (F.floor, 6.0)))]
    star = F.when(lit, F.struct("x", "y", F.pow(F.lit(10.0), -0.4 * (F.col("mag") - 25.0)).alias("f"), *ends))
    spread = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own would not be merged to few by the size of the stars
    fields = refs.select("field_id", star.alias("s")).repartition(spread, "field_id").groupBy("field_id").agg(F.collect_list("s").alias("stars"))
    whole = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    px, py, x0 = F.col("px"), F.col("py"), F.col("block") * 20
    lines = fields.select("field_id", "stars", whole(200).alias("py"))
    lines = lines.select("field_id", "py", F.filter("stars", lambda s: (s["y0"] <= py) & (s["y1"] >= py)).alias("stars"), whole(10).alias("block"))
    lines = lines.select("field_id", "py", x0.alias("x0"), F.filter("stars", lambda s: (s["x0"] <= x0 + 19) & (s["x1"] >= x0)).alias("stars"), whole(20).alias("step"))
    shine = lambda s: F.when((s["x0"] <= px) & (s["x1"] >= px), s["f"] * F.exp(-((px - s["x"]) * (px - s["x"]) + (py - s["y"]) * (py - s["y"])) / 2.88) / 9.04778684).otherwise(0.0)
    light = F.when(F.size("stars") == 0, 0.0).otherwise(F.aggregate("stars", F.lit(0.0), lambda a, s: a + shine(s)))
    v = F.when(((px * 7 + py * 13) % 997 == 0) & (px > 0), -999.0).otherwise(100.0 + px / 20.0 + ((px * 31 + py * 17) % 100) / 100.0 + light)
    return lines.select("field_id", (F.col("x0") + F.col("step")).alias("px"), "py", "stars").select("field_id", "px", "py", v.alias("v"))


class Tables:
    """The raw tables of one folder and those derived from them, as attributes."""

    RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.RAW:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name == "pixels":
            frame = pixels_of(self.refs)
        elif name in SQL:
            words = [t for t in (*self.RAW, *SQL) if t != name and f" {t}" in SQL[name].replace("\n", " ")]
            text = text_of(name, "spark")
            for t in words:
                for lead in ("from ", "join "):
                    text = text.replace(f"{lead}{t} ", f"{lead}{{{t}}} ").replace(f"{lead}{t}\n", f"{lead}{{{t}}}\n").replace(f"{lead}{t})", f"{lead}{{{t}}})")
                if text.endswith(f"from {t}"):
                    text = text[: -len(t)] + f"{{{t}}}"
            used = {t: getattr(self, t) for t in words if f"{{{t}}}" in text}
            frame = self.spark.sql(text, **used)
        else:
            raise AttributeError(name)
        self.__dict__[name] = frame
        return frame

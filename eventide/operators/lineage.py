"""Lineage as data: edges, external datasets, impact and run events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import iso_millis, referenced_tables, uuid_from
from ..schemas import PIPELINE
from ..session import materialise

# The datasets each job reads and writes.
SOURCE_NS, WAREHOUSE_NS, EXPORT_NS = "oracle", "sqlserver", "s3"
JOB_IO = {
    "market_data_ingest": {
        "inputs": [],
        "outputs": [(SOURCE_NS, "src_trade_movements"), (SOURCE_NS, "src_drvt_positions"),
                    (SOURCE_NS, "src_cash_positions")],
        "depends_on": [],
    },
    "close_market_eod": {
        "inputs": [(SOURCE_NS, "src_trade_movements")],
        "outputs": [(WAREHOUSE_NS, "dw_trade_movements")],
        "depends_on": [],
    },
    "reconcile_d1_positions": {
        "inputs": [(SOURCE_NS, "src_drvt_positions"), (SOURCE_NS, "src_cash_positions")],
        "outputs": [(WAREHOUSE_NS, "dw_drvt_positions"), (WAREHOUSE_NS, "dw_cash_positions")],
        "depends_on": ["close_market_eod"],
    },
    "quality_gate_d1": {
        "inputs": [(WAREHOUSE_NS, "dw_trade_movements"), (WAREHOUSE_NS, "dw_drvt_positions"),
                   (WAREHOUSE_NS, "dw_cash_positions")],
        "outputs": [(WAREHOUSE_NS, "dq_results")],
        "depends_on": ["reconcile_d1_positions"],
    },
    "publish_d1_reports": {
        "inputs": [(WAREHOUSE_NS, "dw_trade_movements"), (WAREHOUSE_NS, "dw_drvt_positions"),
                   (WAREHOUSE_NS, "dw_cash_positions"), (WAREHOUSE_NS, "dq_results")],
        "outputs": [(EXPORT_NS, "derivatives/dw_trade_movements.parquet"),
                    (EXPORT_NS, "derivatives/dw_drvt_positions.parquet"),
                    (EXPORT_NS, "spot/dw_cash_positions.csv")],
        "depends_on": ["quality_gate_d1"],
    },
}
KNOWN_NAMESPACES = (SOURCE_NS, WAREHOUSE_NS, EXPORT_NS)


def contract_problems(contract: dict | list[tuple[str, dict]], namespaces: tuple[str, ...] = KNOWN_NAMESPACES) -> list[str]:
    """Repeated job names, unknown dependencies and unknown namespaces of a job contract.

    A contract read from a file is a list of (name, entry), where names can repeat.
    """
    entries = list(contract.items()) if isinstance(contract, dict) else contract
    names = [job for job, _ in entries]
    problems = [f"{job}: repeated name" for job in sorted({n for n in names if names.count(n) > 1})]
    contract = dict(entries)
    for job, io in entries:
        problems += [f"{job}: unknown dependency {d}" for d in io.get("depends_on", []) if d not in contract]
        problems += [
            f"{job}: unknown namespace {ns}"
            for side in ("inputs", "outputs") for ns, _ in io[side] if ns not in namespaces
        ]
    return problems


def lineage_edges(spark: SparkSession, contract: dict = JOB_IO) -> DataFrame:
    """A job contract as (job, direction, namespace, name) rows."""
    problems = contract_problems(contract)
    if problems:
        raise ValueError("; ".join(problems))
    rows = [
        (job, direction, ns, name)
        for job, io in (contract.items() if isinstance(contract, dict) else contract)
        for direction, side in (("input", "inputs"), ("output", "outputs"))
        for ns, name in io[side]
    ]
    return spark.createDataFrame(rows, "job string, direction string, namespace string, name string")


def external_io(edges: DataFrame) -> DataFrame:
    """Datasets read but never written, and written but never read.

    Both set differences come from one aggregation per dataset.
    """
    sides = edges.groupBy("namespace", "name").agg(
        F.bool_or(F.col("direction") == "input").alias("_read"),
        F.bool_or(F.col("direction") == "output").alias("_written"),
    )
    return sides.filter(F.col("_read") != F.col("_written")).select(
        F.when(F.col("_read"), "input").otherwise("output").alias("direction"), "namespace", "name"
    )


def impact(edges: DataFrame, dataset: str, direction: str = "downstream", namespace: str | None = None) -> DataFrame:
    """Datasets reachable from one dataset, with the number of jobs in between."""
    return impacts(edges, {direction: dataset}, namespace).drop("direction")


def impacts(edges: DataFrame, starts: dict[str, str], namespace: str | None = None) -> DataFrame:
    """``direction, namespace, name, depth``: what each start reaches, in one pass.

    ``starts`` maps ``downstream`` and ``upstream`` to a dataset each. Datasets and jobs are
    the vertices. A vertex with one predecessor lies one step behind it, so such vertices
    jump to the last ancestor that has several predecessors, in steps that double: a chain
    takes as many rounds as its length has binary digits. What is left, the vertices where
    paths meet, is gone through by a frontier that writes only the distances it improves.
    Every round is written to the shared folder, so a lost executor repeats one round.
    """
    wanted = [F.struct(F.lit(w).alias("way"), F.lit(w == "downstream").alias("down")) for w in starts]
    rows = edges.select("job", "direction", "namespace", "name").distinct().withColumn("w", F.explode(F.array(*wanted)))
    none = F.lit(None).cast("string")
    dataset = F.struct(F.col("namespace").alias("ns"), F.col("name").alias("id"))
    job = F.struct(none.alias("ns"), F.col("job").alias("id"))  # a job has no namespace
    enters = (F.col("direction") == "input") == F.col("w.down")
    hops, _ = materialise(rows.select(
        "w.way", F.when(enters, dataset).otherwise(job).alias("a"), F.when(enters, job).otherwise(dataset).alias("b"),
        enters.alias("enters")), "lineage-edges")
    first = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("way"))
    start = F.col("v.ns").isNotNull() & (F.col("v.id") == first)
    if namespace is not None:
        start = start & (F.col("v.ns") == namespace)
    ends = hops.select("way", F.col("a").alias("v")).unionByName(hops.select("way", F.col("b").alias("v")))
    origin, _ = materialise(ends.filter(start).distinct(), "lineage-start")

    # Vertices with one predecessor, and the vertex and distance they follow from.
    arrivals = hops.groupBy("way", F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("root"))
    single = arrivals.filter("n = 1").join(origin, ["way", "v"], "left_anti")
    single, n = materialise(single.select("way", "v", "root", F.lit(1).cast("long").alias("hops")), "lineage-single")
    for _ in range(n.bit_length() + 1):  # only cycles that no path enters need more
        beyond = single.select("way", F.col("v").alias("root"), F.col("root").alias("_r"), F.col("hops").alias("_h"))
        jumped = single.join(beyond, ["way", "root"], "left").select(
            "way", "v", F.coalesce("_r", "root").alias("root"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"),
            F.col("_r").isNotNull().alias("moved"))
        jumped, _ = materialise(jumped, "lineage-jump")
        single = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break

    # Edges into the vertices where paths meet, from the last such vertex or the start.
    meets = hops.join(single.select("way", F.col("v").alias("b")), ["way", "b"], "left_anti")
    behind = single.select("way", F.col("v").alias("a"), "root", "hops")
    steps, _ = materialise(meets.join(behind, ["way", "a"], "left").groupBy(
        "way", F.coalesce("root", "a").alias("root"), F.col("b").alias("v")).agg(
        F.min(F.coalesce("hops", F.lit(0)) + 1).alias("step")), "lineage-steps")
    frontier, _ = materialise(origin.select("way", "v", F.lit(0).cast("long").alias("dist")), "lineage-level")
    known = [frontier]
    while True:
        found = reduce(DataFrame.unionByName, known).groupBy("way", "v").agg(F.min("dist").alias("best"))
        reached = steps.join(frontier.select("way", F.col("v").alias("root"), "dist"), ["way", "root"]).groupBy("way", "v").agg(
            F.min(F.col("dist") + F.col("step")).alias("dist"))
        better = reached.join(found, ["way", "v"], "left").filter(F.col("best").isNull() | (F.col("dist") < F.col("best")))
        frontier, improved = materialise(better.select("way", "v", "dist"), "lineage-level")
        if not improved:
            break
        known.append(frontier)
    met = reduce(DataFrame.unionByName, known).groupBy("way", "v").agg(F.min("dist").alias("dist"))
    trailing = single.join(met.withColumnRenamed("v", "root"), ["way", "root"]).select(
        "way", "v", (F.col("dist") + F.col("hops")).alias("dist"))
    return met.unionByName(trailing).filter("v.ns IS NOT NULL AND dist > 0").select(
        F.col("way").alias("direction"), F.col("v.ns").alias("namespace"), F.col("v.id").alias("name"),
        (F.col("dist") / 2).cast("int").alias("depth"))


def sql_inputs(queries: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Distinct tables each query text reads."""
    return queries.select(*keys, F.explode(referenced_tables(column)).alias("table_name")).distinct()


def run_ids(df: DataFrame, job: str = "job_name", day: str = "business_date", ts: str = "ts") -> DataFrame:
    """Run id per job, date and minute, and parent id per date and hour."""
    date_text = F.date_format(day, "yyyy-MM-dd")
    minute = F.date_format(ts, "yyyyMMdd'T'HHmm")
    hour = F.date_format(ts, "yyyyMMdd'T'HH")
    return df.withColumns({
        "ol_run_id": uuid_from(job, date_text, minute),
        "ol_parent_run_id": uuid_from(F.lit(PIPELINE), date_text, hour),
    })


PRODUCER = "urn:eventide"
FACETS = "https://openlineage.io/spec/facets"


def _facet(kind: str, *fields: Column) -> Column:
    return F.struct(F.lit(PRODUCER).alias("_producer"), F.lit(f"{FACETS}/{kind}.json").alias("_schemaURL"), *fields)


def run_events(
    runs: DataFrame, edges: DataFrame, namespace: str = "eventide", shift_hours: int = 0,
    fields: dict[str, list[tuple[str, str]]] | None = None, max_error_chars: int | None = None,
) -> DataFrame:
    """Run rows as lineage events in JSON.

    Error texts are sent whole unless ``max_error_chars`` limits them.

    ``runs`` needs ``job_name, business_date, ts, run_id, parent_run_id,
    event_type, row_count, error``. Row counts are those of the run, and appear
    on the outputs of completed runs. ``fields`` lists the columns per dataset.
    """
    columns = fields or {}
    flat = [x for name, cols in columns.items() for x in (
        F.lit(name), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in cols])
    )]
    if flat:
        layout = F.try_element_at(F.create_map(*flat), F.col("name"))
    else:
        layout = F.lit(None).cast("array<struct<name:string,type:string>>")
    schema_facet = F.when(layout.isNotNull(), _facet("1-0-0/SchemaDatasetFacet", layout.alias("fields")))
    dataset = F.struct("namespace", "name", F.struct(schema_facet.alias("schema")).alias("facets"))
    # The contract holds a handful of datasets per job; order them by name.
    io = edges.groupBy(F.col("job").alias("job_name")).agg(
        F.sort_array(F.collect_list(F.when(F.col("direction") == "input", dataset))).alias("_in"),
        F.sort_array(F.collect_list(F.when(F.col("direction") == "output", dataset))).alias("_out"),
    )
    statistics = F.when(
        (F.col("event_type") == "COMPLETE") & F.col("row_count").isNotNull(),
        F.struct(_facet("1-0-0/OutputStatisticsOutputDatasetFacet", F.col("row_count").alias("rowCount")).alias("outputStatistics")),
    )
    outputs = F.transform("_out", lambda d: F.struct(
        d["namespace"].alias("namespace"), d["name"].alias("name"), d["facets"].alias("facets"), statistics.alias("outputFacets"),
    ))
    message = F.col("error") if max_error_chars is None else F.substring("error", 1, max_error_chars)
    failure = F.when(
        (F.col("event_type") == "FAIL") & F.col("error").isNotNull(),
        _facet("1-0-0/ErrorMessageRunFacet", message.alias("message"), F.lit("Python").alias("programmingLanguage")),
    )
    event = F.struct(
        F.col("event_type").alias("eventType"),
        iso_millis("ts", shift_hours).alias("eventTime"),
        F.struct(
            F.col("run_id").alias("runId"),
            F.struct(
                _facet("1-0-0/CustomFacet", F.date_format("business_date", "yyyy-MM-dd").alias("business_date")).alias("business_date"),
                _facet("1-0-0/CustomFacet", F.lit(PIPELINE).alias("pipeline"), F.col("parent_run_id").alias("pipelineRunId")).alias("orchestration"),
                failure.alias("errorMessage"),
            ).alias("facets"),
        ).alias("run"),
        F.struct(
            F.lit(namespace).alias("namespace"), F.col("job_name").alias("name"),
            F.struct(_facet(
                "2-0-3/JobTypeJobFacet", F.lit("BATCH").alias("processingType"), F.lit("custom").alias("integration"),
                F.lit("JOB").alias("jobType"),
            ).alias("jobType")).alias("facets"),
        ).alias("job"),
        F.col("_in").alias("inputs"), outputs.alias("outputs"),
        F.lit(PRODUCER).alias("producer"),
        F.lit("https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent").alias("schemaURL"),
    )
    # One row a job of the contract: the runs, which hold few job names, are not dealt out by them.
    return runs.join(F.broadcast(io), "job_name", "left").select("run_id", "job_name", "event_type", F.to_json(event).alias("event"))

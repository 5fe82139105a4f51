"""Views of the driver's tables as relations of the message domain.

Each view is a table and a list of expressions that Spark and DuckDB both read,
so that a query and its SQL begin from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators.lexical import LexicalIndex, StaleIndex, open_index, write_index
from colloquy.session import dealt_out, files_fingerprint, read_table, shared_path

Query = Callable[[SparkSession, str], DataFrame]

VIEWS: dict[str, tuple[str, list[str]]] = {
    "message": ("events", [
        "event_id AS message_id", "user_id AS chat_id", "ts AS sent_at", "event_type = 'purchase' AS is_from_me", "event_type = 'error' AS is_unsent", "event_type = 'view' AS has_attachments",
        "CASE WHEN event_type = 'purchase' THEN NULL ELSE user_id END AS sender_person_id", "props AS text", "value", "concat('g', CAST(event_id AS STRING)) AS source_guid", "event_type AS kind",
    ]),
    "turn": ("conversations", ["conv_id AS chat_id", "turn AS message_id", "turn AS sent_at", "role AS sender", "text"]),
    "person": ("customer", ["c_custkey AS person_id", "c_name AS display_name", "replace(lower(c_name), '#', '-') AS short_name", "c_custkey = 0 AS is_owner", "c_mktsegment AS segment"]),
    "allowlist": ("customer", ["c_custkey AS person_id", "c_acctbal > 2000 AS text_allowed", "c_mktsegment = 'BUILDING' AS attachments_allowed"]),
    "chat": ("orders", ["o_orderkey AS chat_id", "o_orderstatus AS status", "o_orderdate AS started_at", "o_orderpriority AS priority"]),
    "direct": ("orders", ["o_orderkey AS chat_id", "o_custkey AS person_id"]),
    "recipient": ("orders", ["o_orderkey AS chat_id", "o_custkey AS person_id", "o_orderpriority AS priority", "o_orderstatus AS status"]),
    "line": ("lineitem", ["l_orderkey AS chat_id", "l_partkey AS attachment_id", "l_suppkey AS supplier_id", "l_linenumber AS ordinal", "l_shipdate AS sent_at", "l_returnflag AS flag", "l_quantity AS quantity"]),
    "segment": ("documents", ["doc_id AS segment_id", "source AS chat", "lang", "text", "n_chars"]),
    "vector": ("embeddings", ["vec_id AS segment_id", "embedding AS vec", "label"]),
    "page": ("pages", ["page_id", "url", "html"]),
    "bench": ("benchmark", ["item_id AS query_id", "text AS query_text"]),
    "label": ("labels", ["doc_id AS segment_id", "quality + CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END AS grade"]),
    "attachment": ("part", [
        "p_partkey AS attachment_id", "p_name AS filename", "p_size AS tries", "p_retailprice AS price",
        "CASE p_type WHEN 'ECONOMY' THEN 'application/pdf' WHEN 'SMALL' THEN 'image/png' WHEN 'MEDIUM' THEN 'audio/mp4' WHEN 'LARGE' THEN 'video/mp4' ELSE 'text/plain' END AS mime_type",
        "CASE p_size % 5 WHEN 0 THEN 'dataless' WHEN 1 THEN 'missing' WHEN 2 THEN 'error' ELSE 'materialized' END AS state", "p_size % 7 <> 3 AS on_disk",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return read_table(spark, sf_dir, table).selectExpr(*columns)


def sql(body: str, *names: str, ctes: str = "") -> str:
    """``body`` with the views that it names in front, as DuckDB reads them."""
    parts = [f"{n} AS (SELECT {', '.join(c.replace('AS STRING', 'AS VARCHAR') for c in VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts + ([ctes] if ctes else [])) + "\n" + body


_indexes: dict[tuple[str, str, str], LexicalIndex] = {}


def _segments_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/{VIEWS['segment'][0]}.parquet"


def _segments_source(spark: SparkSession, sf_dir: str) -> str:
    return files_fingerprint(spark, _segments_path(sf_dir))


def rebuild_index(spark: SparkSession, sf_dir: str, position: int = 0, kind: str = "word") -> LexicalIndex:
    """Make the index of the segments of a data folder anew; searches see this version from then on."""
    where = (spark.sparkContext.applicationId, sf_dir, kind)
    folder = _indexes[where].folder if where in _indexes else shared_path(spark, "postings")
    source = _segments_source(spark, sf_dir)  # before the table is read
    docs = dealt_out(spark, view(spark, sf_dir, "segment").select("segment_id", "text"), _segments_path(sf_dir))
    _indexes[where] = write_index(docs, folder, position, kind=kind, source=source)
    return _indexes[where]


def segment_index(spark: SparkSession, sf_dir: str, kind: str = "word") -> LexicalIndex:
    """The index of the segments of a data folder, kept in the shared folder for the application; made if there is none, or if the table's files have changed since."""
    where = (spark.sparkContext.applicationId, sf_dir, kind)
    if where in _indexes:
        try:
            return open_index(spark, _indexes[where].folder, kind, _segments_source(spark, sf_dir))
        except StaleIndex:
            pass
    return rebuild_index(spark, sf_dir, kind=kind)


REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (run, oracle)
        return run

    return add

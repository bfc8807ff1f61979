"""Results as JSON answers: texts, tables, parsed documents, chunks, plans, and errors with their status.

Every answer is one row a document, made by an aggregate and to_json; save writes the rows as JSON lines, a folder for each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_page

#: Codes of errors and their status.
STATUS = {
    "FILE_READ_ERROR": 400,
    "PDF_PARSE_ERROR": 400,
    "FILE_EMPTY": 400,
    "INVALID_UPLOAD_REQUEST": 400,
    "FILE_TOO_LARGE": 413,
    "UNSUPPORTED_FILE_TYPE": 400,
    "UNSUPPORTED_LLM_MODEL": 400,
    "LLM_NOT_CONFIGURED": 503,
    "LLM_REQUEST_FAILED": 502,
    "LLM_INVALID_RESPONSE": 502,
}


def _listed(rows: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    return rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda s: s["x"]).alias(name))


def text_answer(pages: DataFrame) -> DataFrame:
    """(doc, json): the pages (doc, page, text) of each document with their numbers, texts normalized."""
    item = F.struct(F.col("page").alias("pageNumber"), normalize_page(F.col("text")).alias("text"))
    return _listed(pages, "page", item, "pages").select("doc", F.to_json(F.struct(F.size("pages").alias("pageCount"), "pages")).alias("json"))


def table_answer(tables: DataFrame) -> DataFrame:
    """(doc, json): the tables (doc, table, first_page, last_page, rows of cells and page) of each document, as assembly.assemble makes them."""
    cells = F.transform("rows", lambda r: r["cells"])
    item = F.struct(F.col("table").alias("tableNumber"), F.col("first_page").alias("startPage"), F.col("last_page").alias("endPage"), cells.alias("rows"))
    return _listed(tables, "table", item, "tables").select("doc", F.to_json(F.struct(F.size("tables").alias("tableCount"), "tables")).alias("json"))


def parsed_answer(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, json): pages with the tables that begin on them; tables keep their numbers, which run through the document."""
    item = F.struct(F.col("table").alias("tableNumber"), F.col("last_page").alias("endPage"), F.transform("rows", lambda r: r["cells"]).alias("rows"))
    on_page = tables.groupBy("doc", F.col("first_page").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("tables"))
    joined = pages.join(on_page, ["doc", "page"], "left")
    none = F.array().cast(on_page.schema["tables"].dataType)
    page = F.struct(F.col("page").alias("pageNumber"), normalize_page(F.col("text")).alias("text"), F.coalesce("tables", none).alias("tables"))
    return _listed(joined, "page", page, "pages").select("doc", F.to_json(F.struct("pages")).alias("json"))


def chunk_answer(chunks: DataFrame) -> DataFrame:
    """(doc, json): chunks (doc, chunk_no, path, content, tokens) in their order."""
    item = F.struct(F.col("chunk_no").alias("chunkNumber"), F.col("path").alias("sectionPath"), F.col("tokens").alias("tokenCount"), "content")
    return _listed(chunks.where("chunk_no is not null"), "chunk_no", item, "chunks").select("doc", F.to_json(F.struct(F.size("chunks").alias("chunkCount"), "chunks")).alias("json"))


def plan_answer(plans: DataFrame, plan: str = "plan", json: str = "json", model: str = "model") -> DataFrame:
    """(plan, json): the model's code and the plan; a plan that isn't JSON is null in it."""
    body = F.to_json(F.struct(F.col(model).alias("modelCode"), F.try_parse_json(json).alias("plan")), {"ignoreNullFields": "false"})
    return plans.select(F.col(plan).alias("plan"), body.alias("json"))


def error_answer(errors: DataFrame, at: Column | None = None) -> DataFrame:
    """(doc, json): errors (doc, code, message, details as a map) with the status of their code, 500 for codes of no other, and the time."""
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("code")), F.lit(500))
    when = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    details = F.coalesce("details", F.expr("cast(map() as map<string,string>)"))
    return errors.select("doc", F.to_json(F.struct("code", status.alias("status"), "message", details.alias("details"), when.alias("timestamp"))).alias("json"))


def save(answers: DataFrame, folder: str, kind: str) -> None:
    """The rows as JSON lines in a folder of their kind, written by all tasks."""
    answers.write.mode("overwrite").json(f"{folder.rstrip('/')}/{kind}")

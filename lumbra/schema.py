"""Table schemas, fixed value sets and validity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DOCUMENT = _struct(id=_S, title=_S, content=_S, source=_S, doc_type=_S, metadata=_MAP, created_at=_TS, updated_at=_TS, version=_I, status=_S)
CHUNK = _struct(id=_S, document_id=_S, content=_S, start_pos=_I, end_pos=_I, chunk_index=_I, token_count=_I, page_number=_I, heading_path=T.ArrayType(_S), created_at=_TS)
VECTOR = _struct(id=_S, vector=T.ArrayType(T.FloatType()), metadata=_MAP, created_at=_TS)
RESULT = _struct(query_id=_S, strategy=_S, rank=_I, id=_S, content=_S, score=_D, rerank_score=_D, source=_S, document_id=_S, chunk_id=_S, metadata=_MAP)
ENTITY = _struct(id=_S, name=_S, type=_S, aliases=T.ArrayType(_S), description=_S, properties=_MAP, source_doc_id=_S, confidence=_D)
RELATION = _struct(id=_S, source_id=_S, target_id=_S, type=_S, properties=_MAP, source_doc_id=_S, confidence=_D)
HASH_INDEX = _struct(hash=_S, document_id=_S, content_size=_L, created_at=_TS, source=_S)
ACL = _struct(doc_id=_S, owner=_S, readers=T.ArrayType(_S), writers=T.ArrayType(_S), public=T.BooleanType(), groups=T.ArrayType(_S))
RUN = _struct(query_id=_S, rank=_I, doc_id=_S)
QRELS = _struct(query_id=_S, doc_id=_S, relevance=_D)
FILE_EVENT = _struct(path=_S, name=_S, ext=_S, event=_S, is_dir=T.BooleanType(), timestamp=_TS)
#: A document's parts in reading order; the section tree is a path because structs can't nest in themselves.
ELEMENT = _struct(
    doc_id=_S, page=_I, section_path=T.ArrayType(_S), ord=_I, type=_S, level=_I, text=_S, language=_S, ordered=T.BooleanType(), items=T.ArrayType(_S), headers=T.ArrayType(_S), rows=T.ArrayType(T.ArrayType(_S))
)

# Fixed values.
DOC_TYPES = ("pdf", "docx", "md", "html", "txt", "csv", "json")
STATUSES = ("pending", "processing", "indexed", "failed", "deleted")
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "DATE", "PRODUCT", "EVENT", "CONCEPT", "TECHNOLOGY", "INDUSTRY")
RELATION_TYPES = ("WORKS_FOR", "LOCATED_IN", "FOUNDED_BY", "PART_OF", "RELATED_TO", "USES", "PRODUCES", "COMPETES_WITH", "INVESTED_IN", "ACQUIRED", "PARTNERED_WITH")


def valid_document(id_col: str = "id", content: str = "content") -> Column:
    """A document needs an id and a content; null counts as empty."""
    return (F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(content), F.lit("")) != "")


def meta(metadata: str | Column, key: str) -> Column:
    """A metadata value as text, '' if the map or the key is absent."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def stable_id(*parts: str | Column) -> Column:
    """An id that is the same in every run for the same parts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p if isinstance(p, Column) else F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256)

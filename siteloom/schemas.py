"""Fixed schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LANDED = _struct(url=_S, content_type=_S, html=_S, body=T.BinaryType(), fetched_at=_TS)
PAGES = _struct(url=_S, base_name=_S, title=_S, language=_S, section=_S, html=_S, markdown=_S,
                content_hash=_S, crawled_at=_TS, lastmod=_TS, host=_S)
ASSETS = _struct(url=_S, kind=_S, source_page=_S, content_type=_S, body=T.BinaryType(),
                 content_hash=_S, crawled_at=_TS, language=_S)
ARTIFACTS = _struct(container=_S, name=_S, content_type=_S, data=T.BinaryType(),
                    metadata=T.MapType(_S, _S))
MANIFEST = _struct(container=_S, name=_S, base_name=_S, content_hash=_S, modified_at=_TS,
                   deleted_at=_TS)
OCR_TEXT = _struct(parent_id=_S, content_offset=T.LongType(), ord=T.IntegerType(), text=_S)
SOURCES = _struct(parent_id=_S, title=_S, source_url=_S, language=_S, section=_S, kind=_S,
                  crawled_at=_TS, content_hash=_S, content=_S)
CHUNKS = _struct(id=_S, parent_id=_S, ord=T.IntegerType(), chunk=_S,
                 vector=T.ArrayType(T.FloatType(), False), title=_S, source_url=_S, language=_S,
                 section=_S, kind=_S, crawled_at=_TS, content_hash=_S)
QUERIES = _struct(qid=T.LongType(), q=_S, language=_S, section=_S, kind=_S, top=T.IntegerType(),
                  skip=T.IntegerType())

# What each index field may be used for.
FIELD_ABILITIES = {
    "id": {"key", "searchable", "filterable", "sortable"},
    "parent_id": {"filterable"},
    "chunk": {"searchable"},
    "vector": {"searchable"},
    "title": {"searchable"},
    "source_url": {"filterable"},
    "language": {"filterable", "facetable"},
    "section": {"filterable", "facetable"},
    "kind": {"filterable", "facetable"},
    "crawled_at": {"filterable", "sortable"},
    "content_hash": {"filterable"},
}
# Fields a query may filter on and gets facets for.
FILTER_FIELDS = ("language", "section", "kind")


def fields_with(ability: str) -> set[str]:
    return {name for name, abilities in FIELD_ABILITIES.items() if ability in abilities}

"""Schemas of annotated text: documents hold passages, passages hold annotations and relations."""

from __future__ import annotations

INFON = "ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
LOCATION = "STRUCT<_offset: INT, _length: INT>"
ANNOTATION = f"STRUCT<_id: STRING, infon: {INFON}, location: ARRAY<{LOCATION}>, text: STRING>"
RELATION = f"STRUCT<_id: STRING, infon: {INFON}, node: ARRAY<STRUCT<_refid: STRING, _role: STRING>>>"
PASSAGE = f"STRUCT<infon: {INFON}, offset: INT, text: STRING, annotation: ARRAY<{ANNOTATION}>, relation: ARRAY<{RELATION}>>"
#: A row of the XML source with row tag ``document``.
DOCUMENT = f"id STRING, infon {INFON}, passage ARRAY<{PASSAGE}>"

#: Passage metadata, one JSON object a line.
METADATA = "passage_id STRING, data STRUCT<PUBLICATION_YEAR: STRING, JOURNAL_NAME: STRING, MESH_CLUSTERS: ARRAY<STRING>, PASSAGE_TYPE: STRING>"
TOKENS = "id BIGINT, document_id STRING, ner_tags ARRAY<STRING>, tokens ARRAY<STRING>, spans ARRAY<ARRAY<INT>>"

# Entity types and the pseudo-types of evaluation.
ENTITY_TYPES = ("cell_phenotype", "cell_hetero", "cell_vague")
MERGED, POOL = "merged", "pool"

"""quillmesh: Spark DataFrame operators over text and source-code corpora."""

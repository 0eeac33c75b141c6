"""Fixed schemas and vocabularies of the species-list data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of one resolved name.
CANONICAL_COLUMNS = (
    "query_name", "scientificName", "taxonomicStatus", "validation_status",
    "match_count", "provider", "taxonID", "taxonRank", "acceptedNameUsageID",
    "kingdom", "phylum", "class", "order", "family", "genus",
    "specificEpithet", "infraspecificEpithet", "vernacularName",
    "scientificNameAuthorship", "establishmentMeans", "taxonRemarks",
)

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c == "match_count" else T.StringType())
        for c in CANONICAL_COLUMNS
    ]
)

# Taxonomy columns written onto a record. The name columns take
# the resolved value even when it is null; the fill columns keep the typed
# value when the resolved one is blank.
NAME_COLUMNS = (
    "scientificName", "taxonID", "taxonRank", "taxonomicStatus",
    "acceptedNameUsageID", "genus", "specificEpithet", "infraspecificEpithet",
)
FILL_COLUMNS = (
    "kingdom", "phylum", "class", "order", "family", "vernacularName",
    "scientificNameAuthorship", "establishmentMeans", "taxonRemarks",
)

# Audit columns in output order.
AUDIT_COLUMNS = (
    "originalName", "queryName", "validator", "matchType",
    "finalScientificName", "decisionReason", "taxonRank", "taxonomicStatus",
    "taxonID", "kingdom", "phylum", "class", "order", "family", "genus",
    "specificEpithet", "infraspecificEpithet",
)

# Ranks above genus; such a name has no genus part.
SUPRA_GENERIC_RANKS = (
    "domain", "kingdom", "subkingdom", "phylum", "division", "subphylum",
    "superclass", "class", "subclass", "infraclass", "superorder", "order",
    "suborder", "infraorder", "parvorder", "superfamily", "family",
    "subfamily", "tribe", "subtribe",
)

# The four answers of the distribution check, in display order.
FLAG_CONFIRMED = "confirmada"
FLAG_NEAR_ABSENT = "sem registro próximo, presente no estado/bioma"
FLAG_OUTSIDE = "sem registro no estado/bioma"
FLAG_NO_DATA = "sem dados disponíveis"
FLAG_LEVELS = (
    ("confirmed", FLAG_CONFIRMED),
    ("near_absent", FLAG_NEAR_ABSENT),
    ("outside", FLAG_OUTSIDE),
    ("no_data", FLAG_NO_DATA),
)

# Federal lists that newer lists replaced, as number/year.
REPLACED_SOURCES = ("148/2022", "443/2014", "444/2014", "445/2014")

# Fixed value: search radius around a study area, in metres.
BUFFER_METRES = 10_000.0

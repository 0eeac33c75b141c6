"""Input views derived from the driver's tables.

The tables hold no species, coordinates or polygons, so these views derive them
by arithmetic on keys. One SQL text serves both engines: Spark runs it here, and
the reference SQL carries it as leading CTEs.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS: dict[str, str] = {
    "v_taxa": """
SELECT p_partkey AS k,
 concat(upper(substr(p_name,1,1)), substr(p_name,2), translate(cast((p_partkey*7919) % 1000003 AS VARCHAR(20)),'0123456789','abcdefghij')) AS species,
 concat(upper(substr(p_name,1,1)), substr(split_part(p_name,' ',1),2)) AS genus,
 concat(upper(substr(p_type,1,1)), lower(substr(p_type,2)),'aceae') AS family
FROM part""",
    "v_flora": """
SELECT t.k AS seq, t.species, concat(t.species,' Mart.') AS scientificName,
 CASE WHEN t.k % 10 = 0 THEN a.species ELSE t.species END AS acceptedName,
 CASE WHEN t.k % 10 = 0 THEN 'Synonym' ELSE 'Accepted' END AS taxonomicStatus,
 'Plantae' AS kingdom, t.genus, t.family, 'Species' AS taxonRank, concat('F',t.k) AS id,
 CASE t.k % 4 WHEN 0 THEN 'SP;RJ' WHEN 1 THEN 'DF; GO' WHEN 2 THEN 'AM' ELSE NULL END AS states,
 CASE t.k % 5 WHEN 0 THEN 'Cerrado' WHEN 1 THEN 'Amazon;Unknown' ELSE NULL END AS biome,
 CASE t.k % 3 WHEN 0 THEN 'Native' WHEN 1 THEN 'Naturalized' ELSE NULL END AS origin,
 CASE t.k % 2 WHEN 0 THEN 'Endemic' ELSE 'Unknown' END AS endemism
FROM v_taxa t LEFT JOIN v_taxa a ON a.k = t.k + 4 WHERE t.k % 2 = 0
UNION ALL
SELECT t.k + 1000000, t.species, concat(t.species,' Engel'), a.species, 'Synonym', 'Plantae', t.genus, t.family,
 'Species', concat('G',t.k), 'RS', 'Pampa', NULL, 'Non-endemic'
FROM v_taxa t JOIN v_taxa a ON a.k = t.k + 4 WHERE t.k % 14 = 0
UNION ALL
-- Spellings that this list alone accepts; the backbone has only the usual one.
SELECT k + 2000000, concat(species, substr(species,length(species),1)), concat(species, substr(species,length(species),1), ' Schult.'),
 concat(species, substr(species,length(species),1)), 'Accepted', 'Plantae', genus, family, 'Species', concat('H',k), 'SP', NULL, NULL, NULL
FROM v_taxa WHERE k % 8 = 4""",
    "v_fauna": """
SELECT k AS seq, species, species AS validName, CASE WHEN k % 9 = 0 THEN 'synonym' ELSE 'valid' END AS taxonomicStatus,
 genus, family, 'species' AS taxonRank, concat('A',k) AS id,
 CASE k % 4 WHEN 0 THEN 'BA' WHEN 1 THEN 'SP,MG' ELSE NULL END AS states
FROM v_taxa WHERE k % 3 = 0""",
    "v_backbone": """
SELECT k AS usageKey, species AS canonicalName,
 CASE WHEN k % 7 = 0 THEN 'SYNONYM' WHEN k % 11 = 0 THEN 'DOUBTFUL' ELSE 'ACCEPTED' END AS status,
 CASE WHEN k % 7 = 0 THEN k - 1 END AS acceptedUsageKey, 'SPECIES' AS rank,
 CASE WHEN k % 2 = 0 THEN 'Plantae' ELSE 'Animalia' END AS kingdom, family, genus
FROM v_taxa WHERE k % 5 <> 1
UNION ALL
SELECT 5000000 + min(k), genus, CASE WHEN min(k) % 3 = 0 THEN 'SYNONYM' ELSE 'ACCEPTED' END, CAST(NULL AS BIGINT), 'GENUS',
 'Plantae', min(family), genus
FROM v_taxa WHERE length(genus) % 2 = 1 GROUP BY genus""",
    "v_mma": """
SELECT k AS seq, species AS scientificName, lower(species) AS match_key,
 CASE k % 5 WHEN 0 THEN 'VU' WHEN 1 THEN 'EN' WHEN 2 THEN 'CR' WHEN 3 THEN 'CR (PEX)' ELSE 'NT' END AS category,
 'Portaria 1.783/2026' AS source
FROM v_taxa WHERE k % 6 = 0
UNION ALL
SELECT k + 1000000, species, lower(species), CASE k % 3 WHEN 0 THEN 'CR' ELSE 'VU' END, 'Portaria 1.704/2026'
FROM v_taxa WHERE k % 12 = 0""",
    "v_records": """
SELECT o.o_orderkey AS record_id,
 CASE o.o_custkey % 8 WHEN 0 THEN concat(t.species,' (Linnaeus, 1771)')
  WHEN 1 THEN concat(t.genus,' cf. ',split_part(t.species,' ',2)) WHEN 2 THEN concat(t.genus,' sp.')
  WHEN 3 THEN upper(t.species) WHEN 4 THEN concat(t.species,' (Lam.) de Wit')
  WHEN 5 THEN concat(t.species,substr(t.species,length(t.species),1)) WHEN 6 THEN concat(t.species,' var. minor')
  ELSE t.species END AS scientificName,
 CASE WHEN o.o_custkey % 11 = 0 THEN concat('old-',o.o_orderkey) END AS taxonID,
 CAST(NULL AS VARCHAR(20)) AS kingdom, concat('Fazenda ', o.o_custkey % 7) AS locality,
 CASE o.o_custkey % 9 WHEN 0 THEN 'Portaria 148/2022' WHEN 1 THEN 'Portaria SEMA 148/2022' END AS statusSource,
 CASE WHEN o.o_custkey % 9 < 2 THEN 'VU' END AS status
FROM orders o JOIN v_taxa t ON t.k = o.o_orderkey % (SELECT count(*) FROM part)""",
    # The records with the further columns a full sheet carries.
    "v_sheet": """
SELECT record_id, scientificName, taxonID, kingdom, locality, statusSource, status,
 CASE WHEN record_id % 13 = 0 THEN 'typed family' END AS family,
 CASE WHEN record_id % 17 = 0 THEN 'typed genus' END AS genus,
 CAST(NULL AS VARCHAR(20)) AS specificEpithet,
 CASE WHEN record_id % 19 = 0 THEN 'Maas' END AS infraspecificEpithet,
 CAST(NULL AS VARCHAR(20)) AS taxonRank, CAST(NULL AS VARCHAR(20)) AS scientificNameAuthorship,
 CASE WHEN record_id % 5 = 0 THEN 'old flag' END AS distributionFlag,
 CASE WHEN record_id % 23 = 0 THEN 'DD' END AS statusIUCN, CAST(NULL AS VARCHAR(20)) AS criteria
FROM v_records""",
    "v_occ": """
SELECT DISTINCT o.key, o.taxonKey, o.taxonKey AS speciesKey, g.usageKey AS genusKey,
 o.decimalLongitude, o.decimalLatitude, o.datasetKey
FROM (SELECT l_orderkey * 10 + l_linenumber AS key, l_partkey AS taxonKey,
  cast(-50.0 + ((l_orderkey * 7919 + l_linenumber * 101) % 4000) / 1000.0 AS DOUBLE) AS decimalLongitude,
  cast(-24.0 + ((l_orderkey * 104729 + l_linenumber * 331) % 4000) / 1000.0 AS DOUBLE) AS decimalLatitude,
  concat('ds-', l_suppkey % 5) AS datasetKey FROM lineitem) o
LEFT JOIN v_taxa t ON t.k = o.taxonKey
LEFT JOIN (SELECT usageKey, genus FROM v_backbone WHERE rank = 'GENUS') g ON g.genus = t.genus""",
    # Odd areas have a second part close by, so that a point can be near both;
    # even ones are wide and have a hole wider than two buffers.
    "v_area_shapes": """
SELECT n_nationkey AS k, 0 AS part, 0 AS ring, 0.0 AS d, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0.1 END AS w FROM nation WHERE n_nationkey < 5
UNION ALL SELECT n_nationkey, 0, 1, 0.1, 0.3 FROM nation WHERE n_nationkey < 5 AND n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 1, 0, 0.13, 0.06 FROM nation WHERE n_nationkey < 5 AND n_nationkey % 2 = 1""",
    "v_area_vertices": """
SELECT concat('Fazenda ', n.k) AS area, n.part, n.ring, s.seq,
 cast(-49.5 + n.k * 0.7 + n.d + CASE WHEN s.seq IN (1,2) THEN n.w ELSE 0.0 END AS DOUBLE) AS lon,
 cast(-23.5 + n.k * 0.6 + n.d + CASE WHEN s.seq IN (2,3) THEN n.w ELSE 0.0 END AS DOUBLE) AS lat
FROM v_area_shapes n CROSS JOIN (SELECT r_regionkey AS seq FROM region) s""",
    # One small plot per customer: a study-area table that grows with the data.
    # Some lie north of the equator, some outside the national zones.
    "v_plot_vertices": """
SELECT concat('Plot ', c.c_custkey) AS area, 0 AS part, 0 AS ring, s.seq,
 cast(-50.0 + (c.c_custkey * 7919 % 4400) / 1000.0 - CASE c.c_custkey % 7 WHEN 3 THEN 17.0 WHEN 5 THEN 36.0 ELSE 0.0 END + CASE WHEN s.seq IN (1,2) THEN 0.08 ELSE 0.0 END AS DOUBLE) AS lon,
 cast(-24.0 + (c.c_custkey * 104729 % 4600) / 1000.0 + CASE WHEN c.c_custkey % 5 = 2 THEN 25.0 ELSE 0.0 END + CASE WHEN s.seq IN (2,3) THEN 0.08 ELSE 0.0 END AS DOUBLE) AS lat
FROM customer c CROSS JOIN (SELECT r_regionkey AS seq FROM region) s""",
    # The records moved to where plots lie, so that every kind of zone has some.
    "v_plot_occ": """
SELECT key, taxonKey, speciesKey, genusKey, datasetKey,
 decimalLongitude - CAST(CASE key % 7 WHEN 3 THEN 17 WHEN 5 THEN 36 ELSE 0 END AS DOUBLE) AS decimalLongitude,
 decimalLatitude + CAST(CASE WHEN key % 5 = 2 THEN 25 ELSE 0 END AS DOUBLE) AS decimalLatitude
FROM v_occ""",
    "v_region_vertices": """
SELECT k.kind, CASE k.kind WHEN 'state' THEN CASE n.n_nationkey WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG'
  WHEN 3 THEN 'DF' WHEN 4 THEN 'GO' WHEN 5 THEN 'BA' WHEN 6 THEN 'AM' WHEN 7 THEN 'AC' ELSE 'RS' END
  ELSE CASE n.n_nationkey % 3 WHEN 0 THEN 'Cerrado' WHEN 1 THEN 'Amazon' ELSE 'Caatinga' END END AS label,
 n.n_nationkey AS part, 0 AS ring, s.seq,
 cast(-50.0 + (n.n_nationkey % 3) * 1.5 + CASE WHEN s.seq IN (1,2) THEN 1.5 ELSE 0.0 END AS DOUBLE) AS lon,
 cast(-24.0 + floor(n.n_nationkey / 3) * 1.5 + CASE WHEN s.seq IN (2,3) THEN 1.5 ELSE 0.0 END AS DOUBLE) AS lat
FROM nation n CROSS JOIN (SELECT r_regionkey AS seq FROM region) s
CROSS JOIN (SELECT 'state' AS kind UNION ALL SELECT 'biome') k WHERE n.n_nationkey < 9""",
    # One uploaded area file per supplier; its kind says what it holds or what is wrong with it.
    "v_uploads": """
SELECT s_suppkey AS k, s_suppkey % 11 AS kind,
 concat('Área ', s_suppkey, CASE s_suppkey % 11 WHEN 8 THEN '.shp' WHEN 10 THEN '.KML' ELSE '.kml' END) AS file,
 -52000 + s_suppkey * 7919 % 6000 AS x, -25000 + s_suppkey * 104729 % 8000 AS y
FROM supplier""",
    # Shapes of the files that may be read: squares by thousandths of a degree, or points (no width).
    "v_upload_rings": """
SELECT k, kind, x, y, 0 AS part, 0 AS ring, 0 AS d, CASE WHEN kind = 2 THEN 0 ELSE 100 END AS w FROM v_uploads WHERE kind IN (0, 1, 2, 3, 10)
UNION ALL SELECT k, kind, x, y, 0, 1, 20, 40 FROM v_uploads WHERE kind IN (0, 10)
UNION ALL SELECT k, kind, x, y, 1, 0, 150, 50 FROM v_uploads WHERE kind = 1
UNION ALL SELECT k, kind, x, y, 2, 0, 250, 30 FROM v_uploads WHERE kind = 1
UNION ALL SELECT k, kind, x, y, 1, 0, 300, 0 FROM v_uploads WHERE kind = 2""",
    "v_upload_vertices": """
SELECT concat('Área ', u.k) AS area, u.part, u.ring, s.seq,
 cast(u.x + u.d + CASE WHEN s.seq IN (1,2) THEN u.w ELSE 0 END AS DOUBLE) / 1000 AS lon,
 cast(u.y + u.d + CASE WHEN s.seq IN (2,3) THEN u.w ELSE 0 END AS DOUBLE) / 1000 AS lat
FROM v_upload_rings u CROSS JOIN (SELECT r_regionkey AS seq FROM region) s WHERE u.w > 0 OR s.seq = 0""",
    # Claimed localities: each area its own, and Fazenda 4 is claimed twice.
    "v_claims": """
SELECT concat('Fazenda ', n_nationkey) AS area, concat('fazenda  ', n_nationkey) AS locality FROM nation WHERE n_nationkey < 5
UNION ALL SELECT 'Fazenda 0', 'FAZENDA-4' FROM nation WHERE n_nationkey = 0""",
    "v_invasive_a": "SELECT k AS seq, species AS scientificName FROM v_taxa WHERE k % 8 = 0",
    "v_invasive_b": """
SELECT k AS seq, CAST(NULL AS VARCHAR(60)) AS scientificName, concat(species, ' L.') AS supplied FROM v_taxa WHERE k % 12 = 0
UNION ALL SELECT -1, CAST(NULL AS VARCHAR(60)), 'Supplied Name' FROM region WHERE r_regionkey = 0""",
    "v_redlist_key": """
SELECT usageKey, CASE usageKey % 6 WHEN 0 THEN 'CR' WHEN 1 THEN 'EN' WHEN 2 THEN 'VU' WHEN 3 THEN 'NT' WHEN 4 THEN 'LC' ELSE 'DD' END AS code
FROM v_backbone""",
    "v_redlist": """
SELECT genus, split_part(canonicalName,' ',2) AS species, CAST(NULL AS VARCHAR(20)) AS infra,
 CASE usageKey % 4 WHEN 0 THEN 'CR' WHEN 1 THEN 'VU' WHEN 2 THEN 'LC' END AS category,
 CASE WHEN usageKey % 4 < 2 THEN concat('B', usageKey % 5, 'ab(iii)') END AS criteria
FROM v_backbone WHERE rank = 'SPECIES' AND usageKey % 3 = 0""",
}



def needed(names: list[str]) -> list[str]:
    """The views behind ``names``, in definition order."""
    wanted: set[str] = set()
    stack = list(names)
    while stack:
        name = stack.pop()
        if name in wanted:
            continue
        wanted.add(name)
        words = set(VIEWS[name].replace("(", " ").replace(")", " ").split())
        stack += [v for v in VIEWS if v != name and v in words]
    return [v for v in VIEWS if v in wanted]


def with_views(names: list[str]) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed(names))


class Inputs:
    """The derived views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.shared: dict[str, object] = {}
        self._tables = {t: spark.read.parquet(os.path.join(folder, f"{t}.parquet")) for t in TABLES}

    def view(self, name: str) -> DataFrame:
        text = f"{with_views([name])}\nSELECT * FROM {name}"
        used = {t: df for t, df in self._tables.items() if f" {t}" in text.replace("\n", " ")}
        for table in used:
            text = _as_argument(text, table)
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        return self.view(f"v_{name}")


def _as_argument(text: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)

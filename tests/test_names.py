import pytest
from pyspark.sql import functions as F

from taxaledger.functions import names as N
from taxaledger.functions import status as S
from taxaledger.functions import text as X


def one(spark, column, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


NORMALIZED = {
    "Panthera onca (Linnaeus, 1771)": "Panthera onca",
    "Cedrela cf. fissilis": "Cedrela fissilis",
    "Inga sp.": "Inga", "sp.": None, "   ": None, None: None,
    "Aus bus var. cus (Author, 1900)": "Aus bus var. cus",
    "Leucaena leucocephala (Lam.) de Wit": "Leucaena leucocephala",
    "Picumnus albosquamatus d'Orbigny, 1840": "Picumnus albosquamatus",
    "Ipomoea neurocephala Hallier f.": "Ipomoea neurocephala",
    "PANTHERA ONCA": "Panthera",
    "aus|bus": "Aus bus", "Mentha x piperita": "Mentha x piperita", "Mentha × piperita": "Mentha piperita",
    "x Aus bus": "x bus", "Aus bus ex Cus & Dus 1999": "Aus bus", "Var. bus": "var. bus", "f.": None,
}


def test_normalize(spark):
    got = one(spark, N.normalize_name, *NORMALIZED)
    assert dict(zip(NORMALIZED, got)) == NORMALIZED


def test_parts(spark):
    cases = {
        "Canis lupus familiaris": ("Canis", "lupus", "familiaris", "subspecies"),
        "Mentha x piperita": ("Mentha", "piperita", None, "species"),
        "Aus bus var.": ("Aus", "bus", None, "species"),
        "Aus bus var. cus": ("Aus", "bus", "cus", "variety"),
        "Inga sp.": ("Inga", None, None, "genus"), "sp. x": (None,) * 4, "Genus cf. species": ("Genus", "species", None, "species"),
        "Genus cf.": ("Genus", None, None, "genus"), "aus BUS": ("Aus", "bus", None, "species"), None: (None,) * 4, "123": (None,) * 4,
    }
    got = one(spark, N.name_parts, *cases)
    assert [tuple(g) for g in got] == list(cases.values())


def test_qualifier_and_keys(spark):
    assert one(spark, N.has_qualifier, "Aus cf. bus", "Aus|sp", "Aus bus", None, "Cfaus bus") == [True, True, False, False, False]
    assert one(spark, X.match_key, "  Açaí-do_Pará ", "nº 5", "× Aus", "---", None) == ["acai do para", "no 5", "x aus", "", None]
    assert one(spark, X.area_slug, "RPPN Rio do Brasil", "---") == ["rppn_rio_do_brasil", "area"]
    assert one(spark, X.list_tokens, "SP; RJ,SP", "Unknown;NA; ", None) == [["SP", "RJ"], [], []]


def test_stale_source_and_labels(spark):
    got = one(spark, S.is_stale_source, "Portaria 148/2022", "Portaria SEMA 148/2022", "Portaria MMA nº 148, de 7 de junho de 2022",
              "Portaria GM/MMA 1.783/2026", "Portaria 148/2022; IUCN", None)
    assert got == [True, False, True, False, False, False]
    assert one(spark, S.federal_reference, "Portaria GM/MMA 1.783/2026") == ["1783/2026"]
    assert one(spark, S.status_label, "vu", "CR(PEX)", "??", None) == [
        "(VU) Vulneravel", "(CR (PEX)) Criticamente Em Perigo (Possivelmente Extinta)", None, None]
    assert one(spark, S.is_threatened, "(CR (PEX)) x", "VU", "NT", None) == [True, True, False, False]


def test_typed_authorship(spark):
    df = spark.createDataFrame(
        [("Panthera  onca (Linnaeus, 1758)", "Panthera onca"), ("Panthera onca sp.", "Panthera onca"), ("Felis onca L.", "Panthera onca")], "t string, n string")
    assert [r[0] for r in df.select(N.typed_authorship("t", "n")).collect()] == ["(Linnaeus, 1758)", None, None]


@pytest.mark.parametrize("has,present,flag", [
    (True, None, S.FLAG_CONFIRMED), (False, True, S.FLAG_NEAR_ABSENT), (False, False, S.FLAG_OUTSIDE),
    (False, None, S.FLAG_NO_DATA), (None, True, S.FLAG_NO_DATA),
])
def test_flag(spark, has, present, flag):
    df = spark.createDataFrame([(has, present)], "h boolean, p boolean")
    assert df.select(S.distribution_flag("h", "p")).first()[0] == flag


def test_a_name_is_parsed_once_behind_an_aggregate(spark):
    """A result of an aggregate is worked out once per mention, so the chain may be mentioned only once."""
    typed = spark.createDataFrame([("AUS BUS (L.) Kunth",), ("x Aus",), ("Aus b\u0001us",), ("(L.)",)], "n string")
    df = typed.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("q", N.normalize_name("n"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[0-9]{4}") == 1
    assert {r["q"] for r in df.collect()} == {"Aus", "x", "Aus b\u0001us", None}

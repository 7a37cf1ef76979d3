import pytest
from pyspark.sql import functions as F

from marlstone.functions.phonetic import double_metaphone, phonetic_code
from marlstone.operators import names, strategies

EXAMPLES = """Smith SM0 XMT;Schmidt XMT SMT;Catherine K0RN KTRN;Katherine K0RN KTRN;Richard RXRT RKRT;Michael MKL MXL;Knight NT NT;Wright RT RT;Laugh LF LF
Xavier SF SFR;Jose HS HS;cabrillo KPRL KPR;Arnow ARN ARNF;Filipowicz FLPTS FLPFX;Wasserman ASRMN FSRMN;Gough KF KF;Bacher PKR PKR;Accident AKSTNT AKSTNT
Edge AJ AJ;Edgar ATKR ATKR;Resnais RSN RSNS;Island ALNT ALNT;Sugar XKR SKR;Biaggi PJ PK;Tagliaro TKLR TLR;Campbell KMPL KMPL;Zhao J J;Breaux PR PR;Rogier RJ RJR
Cagney KKN KKN;Caesar SSR SSR;chianti KNT KNT;McClellan MKLLN MKLLN;Schneider XNTR SNTR;school SKL SKL;Czerny SRN XRN;focaccia FKX FKX;Thomas TMS TMS;orchestra ARKSTR ARKSTR"""


@pytest.mark.parametrize("line", EXAMPLES.replace("\n", ";").split(";"))
def test_published_codes(line):
    name, first, second = line.split()
    assert double_metaphone(name) == (first, second)


def test_codes_of_a_column(spark):
    rows = spark.createDataFrame([(1, "The Catherine of"), (2, "katherine"), (3, None), (4, ""), (5, "42"), (6, "Person no. 7"), (7, "x" * 5000)], "i int, name string")
    got = {r.i: r.code for r in rows.select("i", phonetic_code(F.col("name")).alias("code")).collect()}
    assert got[1] == got[2] == "K0RN" and got[3] is got[4] is got[5] is None
    assert got[6] == "PRSNN" and got[7].startswith("SKS")


@pytest.mark.parametrize("hot", [5000, 7])
def test_one_code_in_every_name(spark, hot):
    known = spark.range(50).select("id", F.when(F.col("id") < 40, "PRSN").when(F.col("id") < 45, "AT").alias("code"))
    asked = spark.createDataFrame([(1, "PRSN"), (2, "AT"), (3, None), (4, "KN"), (5, "PRSN")], "q long, code string")
    got = sorted((r.asked.q, r.known.id) for r in names.sounding_alike(asked, known, hot).collect())
    assert got == sorted([(q, i) for q in (1, 5) for i in range(40)] + [(2, i) for i in range(40, 45)])


def test_seeds_that_sound_alike(spark):
    entities = spark.createDataFrame([(1, "Catherine"), (2, "Bob")], "entity_id long, name string")
    aliases = spark.createDataFrame([(2, "Xmid")], "entity_id long, name string")
    queries = spark.createDataFrame([(1, "Kathryn"), (2, "Schmidt")], "query_id long, asked string")
    assert sorted(map(tuple, strategies.named_seeds(entities, aliases, queries).collect())) == [(1, 1, 1.0)]
    assert strategies.named_seeds(entities, aliases, queries, phonetic=False).count() == 0
    plan = strategies.named_seeds(entities, aliases, queries)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan

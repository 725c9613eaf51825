import pytest

from slipweave.llm import names
from slipweave.sources.tables import Scratch

SLIPS = [("Copper Trading", "Copper Tradnig"), ("Robert Sunderoux", "Robert Sundetoux"), ("Preekarn Maneephaisan", "Preekarrn Maneephaisan")]
APART = [("Martin Keller", "Marvin Keller")]
REFERENCE = [("Donna", "Dee"), ("Donald", "Donny")]
OTHERS = [f"{a}{b}" for a in ("bam", "cor", "dun", "fel", "gor", "hil", "jor", "kel", "lom", "mur") for b in ("aster", "ington", "overe", "ulfsen", "yquist", "eborgh")]


@pytest.mark.parametrize("case", ["tiny table", "small owner", "hot owner"])
def test_a_misspelling_is_linked_whatever_the_size_of_owner_and_table(spark, case):
    rows = [("u", x) for p in SLIPS for x in p]
    if case != "tiny table":
        rows += [("u", x) for p in APART for x in p]
        rows += [(f"o{i % 40}", f"{a} {o}") for i, o in enumerate(OTHERS) for a in ("Martin", "Marvin", "Robert", "Preekarn", "Copper")]
        rows += [(f"o{i}", f"{o} trading") for i, o in enumerate(OTHERS)] + [(f"o{i}", "Willow Tradnig") for i in range(2)]
    if case == "hot owner":
        rows += [("u", f"{a} {o}") for o in OTHERS for a in ("Robert", "Copper", "Preekarn")]
    out = names.link_names(spark.createDataFrame(rows, "user_id string, form string"), spark.createDataFrame(REFERENCE, "given_name string, nickname string"), Scratch(spark, "t"))
    party = {r.form: r.party for r in out.collect() if r.user_id == "u"}
    assert [p for p in SLIPS if party[p[0]] != party[p[1]]] == []
    if case != "tiny table":
        assert [p for p in APART if party[p[0]] == party[p[1]]] == []


LONG = "Anna Beatrix Carlotta Dagmar Elisabet Franziska"
COMPARED = [
    ("Mr Robert Michael Harrowgate", "Robert Harrowgate", "s"), (f"{LONG} Harrowgate", f"{LONG} Harrowgaet", "s"), (f"{LONG} Harrowgate", f"Harrowgate {LONG}", "s"), ("Bartolomeu Harrowgate", "Bartolomeo Harrowgaet", "s"),
    ("Anna Beatrix Carlotta Dagmar Harrowgate", "Anna Dagmar Harrowgate", "s"), ("Robert Michael Harrowgate", "Michael Harrowgate", ""), ("Lotus Frozen Foods Co., Ltd.", "Lotus Foods Co., Ltd.", ""),
    ("Bob Harrowgate", "Bib Herrowgatt", ""), ("Robert Harrowgate", "Robert Lindqvist", ""), (" ".join(["nalao"] * 40), " ".join(["nalao"] * 39 + ["pirus"]), ""),
]


@pytest.mark.parametrize("a, b, says", COMPARED)
def test_names_of_any_number_of_tokens(a, b, says):
    matcher = names.Matcher({}, 1000, {"bob": {"robert"}})
    p, q = names.parse(a), names.parse(b)
    assert matcher.compare(p, q, 10) == matcher.compare(q, p, 10) == says
    assert not says or names.keys_of(p, {}) & names.keys_of(q, {})


def test_a_hot_key_is_spread_and_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT_KEY", 10)
    filed = spark.createDataFrame([(i, 1) for i in range(57)] + [(i, 2) for i in range(3)], "id long, k long")
    got = [tuple(r) for r in names._meetings(filed).collect()]
    assert sorted(got) == sorted([(i, j) for j in range(57) for i in range(j)] + [(i, j) for j in range(3) for i in range(j)])

import itertools

import pytest

from slipweave.llm import names
from slipweave.sources.tables import Scratch

NICK = "given_name string, nickname string"
PARTIES = [
    ["Robert Sjöarwell", "Bob Sjöarwell", "SJÖARWELL R", "Mr. Robert M. Sjöarwell", "Sjöarwell, Robert", "Robert Sjöarwlel", "Robert Sjöarw"],
    ["Maria Sjöarwell"],
    ["Lotus Furniture Co., Ltd.", "Lotus Furn. Co., Ltd.", "Furniture Lotus Co., Ltd.", "The Lotus Furniture Company", "LOTUS FURNITURE CO LTD", "lotus furmiture"],
    ["Lotus Furniture (Branch 2) Co., Ltd.", "Lotus Furniture (Branch 2) Ltd"],
    ["Teak Solar Co., Ltd."],
    ["นายวรชัย พันธ์กุล", "วรชัยพันธ์กุล", "คุณ วรชัย พันธ์กุล", "พันธ์กุล วรชัย", "วรชัย พันธ์กุล (ต้น)", "ว ร ช ั ย พ ั น ธ ์ ก ุ ล"],
    ["บริษัท แสงเดือนการไฟฟ้า จำกัด", "บ. แสงเดือนการไฟฟ้า จก.", "แสงเดือนกาลไฟฟ้า"],
]


def test_spellings_link_and_parties_stay_apart(spark):
    filler = [(f"o{i}", x) for i in range(300) for x in ("Anna Marlow", "Maria Keller", "Robert Keller", "Teak Print Co., Ltd.", "Lotus Solar Co., Ltd.", "Orchid Furniture Co., Ltd.")]
    rows = [("u", x) for p in PARTIES for x in p] + filler + [("u", PARTIES[0][0]), (None, "x"), ("u", None), ("u", ""), ("u", "."), ("u", "x" * 3000)]
    out = names.link_names(spark.createDataFrame(rows, "user_id string, form string"), spark.createDataFrame([("Robert", "Bob"), (None, "x")], NICK), Scratch(spark, "t"))
    party = {r.form: r.party for r in out.collect() if r.user_id == "u"}
    for p in PARTIES:
        assert len({party[x] for x in p}) == 1, [(x, party[x]) for x in p]
    assert len({party[p[0]] for p in PARTIES}) == len(PARTIES) and {"", ".", "x" * 3000} <= set(party)


def test_empty(spark):
    assert names.link_names(spark.createDataFrame([], "user_id string, form string"), spark.createDataFrame([], NICK), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("word", ["abcd", "aabb", "ไฟฟ้า"])
def test_one_edit_and_index(word):
    edits = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + "z" + word[i:] for i in range(len(word) + 1)} | {word[:i] + "z" + word[i + 1 :] for i in range(len(word))}
    edits |= {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    assert all(names.one_edit(word, e) or e == word for e in edits) and not names.one_edit(word, word)
    assert all(names.deletions(word) & names.deletions(e) for e in edits if len(e) > 3)
    assert not any(names.one_edit(word, a + word + b) for a, b in itertools.product("xy", repeat=2))

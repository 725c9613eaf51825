from collections import Counter

import pytest

from slipweave.llm import labelled, pii

FIELD = "struct<value:string>"
PEOPLE = ["Anna Kell", "Peter Marlow", "Worarot Saenphong", "Nattada Rungdamrong", "Ｊüｒｇｅｎ Ost", "สมชาย ใจดี", "มาลี ศรีสุข", "ณัฐดา บุญประเสริฐ", "Lukáš Bréinberg", "Zoë Garelund"]
FIRMS = ["Lotus Furniture Co., Ltd.", "Teak Solar Co., Ltd.", "Copper Print (Branch 3) Co., Ltd.", "บริษัท แสงเดือนการไฟฟ้า จำกัด", "บจก. บัวทองอาหาร", "Harbour Foods Co., Ltd."]
# Sentences written and labelled by hand, of no family: each item in brackets with its kind.
BY_HAND = [
    "receipt at [EMAIL jon.whitfield@acme.co.uk]", "Ms [NAME Priya Raghavan] after she showed", "My name is [NAME Carlos Mendez]", "[ADDRESS 47 Brookside Crescent, Leeds LS6 2AB]", "[ADDRESS 14 rue de la Paix, 75002 Paris]",
    "SSN [ID_NUMBER 078-05-1120]", "passport [ID_NUMBER C01X00T47]", "refund [NAME Somchai Jaidee] today", "write to [EMAIL ann-lee99 (at) river.org] or [EMAIL BOB@HOUSE.NET]", "call [PHONE +49 30 901820] or [PHONE (212) 555-0187]",
    "met us at noon at the bank", "invoice 20240117-33 for 1,250.00 THB", "transfer 593820174411KXB20481 done", "card **** 4821 and ext 204", "Khun [NAME Anong Srisuk] moved to [ADDRESS 88/12 Moo 4, Tambon Bang Phra 20110]", "คุณ[NAME มานะ รักเรียน] โทร [PHONE 081-555-0199]",
    "ที่อยู่ [ADDRESS 12/3 หมู่ 5 ต.บางแก้ว อ.เมือง 50000]", "Herr [NAME Thomas Becker], [ADDRESS Gartenstraße 12, 80331 München]", "Dr. [NAME Amina Yusuf] confirmed", "Contact [NAME Maria Fernanda Lopez], [PHONE 0812345678]",
]


@pytest.fixture(scope="module")
def finder(spark):
    rows = [((f"Mr. {p}" if p.isascii() else f"นาย {p}",), (f,)) for p in PEOPLE for f in FIRMS]
    return labelled.trained(spark.createDataFrame(rows, f"receiver_name {FIELD}, sender_name {FIELD}"))


def counts(finder, texts):
    """(right, found, true) by kind; an item is right if its kind and start are."""
    out = {k: [0, 0, 0] for k in pii.KINDS}
    for (_, items), spans in zip(texts, finder.find([t for t, _ in texts]), strict=True):
        want, got = {(k, a) for k, a, _ in items}, {(pii.KINDS[k], a) for k, a, _ in spans}
        for place, found in enumerate((want & got, got, want)):
            for k, n in Counter(k for k, _ in found).items():
                out[k][place] += n
    return out


def test_families_never_fitted(finder):
    texts = labelled.make([], [], 1200, seed=77, families=labelled.HELD)
    for kind, (right, found, true) in counts(finder, texts).items():
        assert right / found > 0.9 and right / true > 0.85, (kind, right, found, true)


def test_sentences_labelled_by_hand(finder):
    texts = []
    for line in BY_HAND:
        text, items = "", []
        for k, part in enumerate(line.split("[")):
            if k:
                kind, rest = part.split(" ", 1)
                value, after = rest.split("]", 1)
                items.append((kind, len(text), len(text) + len(value)))
                text += value + after
            else:
                text += part
        texts.append((text, items))
    total = [sum(x) for x in zip(*counts(finder, texts).values(), strict=True)]
    assert total[0] / total[1] > 0.85 and total[0] / total[2] > 0.85, total


def test_saved_finder_is_the_same(spark, finder, tmp_path):
    finder.save(spark, str(tmp_path / "finder"))
    texts = [t for t, _ in labelled.make(PEOPLE, FIRMS, 50, seed=3)]
    assert pii.Finder.load(spark, str(tmp_path / "finder")).find(texts) == finder.find(texts)


def test_kept_lines_do_not_change_what_is_found(finder):
    texts = [t for t, _ in labelled.make(PEOPLE, FIRMS, 300, seed=5)]
    once = [finder.find([t])[0] for t in texts]
    finder.kept.clear()
    assert finder.find(texts) == once == finder.find(texts)


def test_redaction_keeps_the_rest(spark, finder):
    note = "Spoke with Ms Anna Kell on +66 81 234 5678 about 986874686782MDP09928"
    rows = [(1, note, "i"), (2, None, "i"), (3, "", "i"), (4, "  ", "i"), (5, "amount differs: 18,171.00", "i"), (6, "x " * 20_000 + "please write to mali.k@pay.test", "i")]
    df = spark.createDataFrame(rows, "id int, text string, start_pos string")
    out = {r.id: r.redacted for r in pii.redact(df, finder).collect()}
    assert out[1] == "Spoke with Ms [NAME] on [PHONE] about 986874686782MDP09928"
    assert (out[2], out[3], out[4], out[5]) == (None, "", "  ", rows[4][1])
    assert out[6].endswith("please write to [EMAIL]") and len(out[6]) > 40_000


def test_found_rows(spark, finder):
    reads = spark.createDataFrame([(1, "tel 081-234-5678"), (2, None)], "read_id long, raw_ocr_text string")
    notes = spark.createDataFrame([(7, "passport AG2112727 of มาลี ศรีสุข"), (None, "x")], "entry_id long, note string")
    got = sorted((r.text_field, r.record_id, r.kind, r.start_pos) for r in pii.find(pii.slip_texts(reads, notes), finder).collect())
    assert got == [("note", 7, "ID_NUMBER", 9), ("note", 7, "NAME", 22), ("raw_ocr_text", 1, "PHONE", 4)]
    assert pii.find(pii.slip_texts(reads.limit(0), notes.limit(0)), finder).count() == 0
    assert pii.slip_texts(reads, notes, blank=True).count() == 4

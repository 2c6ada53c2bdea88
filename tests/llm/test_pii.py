"""Personal information in texts."""

import re

import pytest

from tabulon.llm.pii import MAIL, Finder, find_mentions, redacted

PEOPLE = [("Kelette", "Wexllow"), ("Silulf", "Pascanko"), ("Nevick", "Ostrinko"), ("临溪", "槐"), ("砚舟", "桤"), (None, None)]


@pytest.mark.parametrize(
    "text,mail",
    [
        ("write to <a.b+c@mat.lab.example>.", "a.b+c@mat.lab.example"), ("x_y [at] example.com, please", "x_y [at] example.com"), ("m(at)mat(dot)lab(dot)example", "m(at)mat(dot)lab(dot)example"),
        ("ask jo at example dot org;", "jo at example dot org"), ("s30＠uni-q.example", "s30＠uni-q.example"), ("邮件k7@lab.example，请", "k7@lab.example"),
    ],
)
def test_mail(text, mail):
    assert MAIL.search(text).group() == mail


@pytest.mark.parametrize("text", ["scratch@node16:/runs/X", "the sweep @ 13.3 GPa", "look at example. dot", "snapshot@step254 and"])
def test_no_mail(text):
    assert not MAIL.search(text)


def kinds(text):
    from tabulon.llm.pii import directory_words

    return {(k, text[a:b]) for k, a, b, *_ in Finder(*directory_words(PEOPLE)).spans(text) if k in ("email", "address")}


@pytest.mark.parametrize(
    "text,address",
    [
        ("to Flat 7, 223 Quenby Street, Corriedale Cross ZZ7 5QX", "Flat 7, 223 Quenby Street"), ("at 2270 W Ashcombe-Vale Ave, Apt 33, Town", "2270 W Ashcombe-Vale Ave, Apt 33"), ("at 46 Pellam Blvd., Port", "46 Pellam Blvd."),
        ("an Quarzhofstr. 21b, 01008 Neu", "Quarzhofstr. 21b"), ("au 73 bis, rue du Pré-Cendré, 00152 Saint", "73 bis, rue du Pré-Cendré"), ("地址：石澜大道185号1栋604室。", "石澜大道185号1栋604室"),
    ],
)
def test_street_addresses(text, address):
    assert ("address", address) in kinds(text)


def corpus():
    docs, i = [], 0
    for k in range(12):
        for text in (
            f"Thanks to Kelette Wexllow for the corrected run {k}.", f"Thanks to the Orvane smearing the run {k} converged.", f"Call +1 212 555 01{k:02} when the node hangs.", "Call 212-555-0199 when the node hangs.",
            f"Batch 0000-327-5924{k:02} was written by an older version.", f"Badge request filed, SSN 666-06-66{k:02}, pending.", f"Reviewer: Nevick Ostrinko\n由槐临溪负责检查能带。", f"Checked by Silulf Pascanko. see {k}",
        ):
            docs.append((i, text, "c", 1))
            i += 1
    docs += [(900, "Thanks to Dalando Grisetti for the corrected run.", "c", 1), (901, "", "c", 1), (902, None, "c", 1), (903, "Mail a.b@lab.example or a.b@lab.example " + "log 12 " * 30000, "c", 1)]
    docs += [(904, "Badge request filed, SSN 666-45-7793, pending.", "c", 1), (905, "see the the and for the a to by", "c", 1)]
    return docs


SCHEMA = "doc_id long, text string, instance string, seed int"


def test_seeds_lead_to_unseen_mentions(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    found = find_mentions(spark, docs.select("doc_id", "text"), PEOPLE).cache()
    rows = {(r["doc_id"], r["kind"], r["mention"]) for r in found.collect()}
    assert (900, "name", "Dalando Grisetti") in rows  # no word of it is in the directory
    assert (3, "phone", "212-555-0199") in rows and (2, "phone", "+1 212 555 0100") in rows  # by context and by country code
    assert (904, "id_number", "666-45-7793") in rows and (6, "name", "槐临溪") in rows
    assert not any("Orvane" in m or m.startswith("0000-327") for _, _, m in rows)
    texts = {r["doc_id"]: r for r in redacted(docs.select("doc_id", "text"), found).collect()}
    assert texts[900]["text"] == "Thanks to [NAME] for the corrected run." and texts[902]["text"] is None and texts[901]["text"] == ""
    assert texts[903]["text"].startswith("Mail [EMAIL] or [EMAIL] log") and texts[903]["replaced"] == 2
    assert len(texts) == len(corpus())


def test_no_texts_no_mentions(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_mentions(spark, docs, PEOPLE).count() == 0
    assert find_mentions(spark, spark.createDataFrame([(1, "plain words only")], "doc_id long, text string"), []).count() == 0


def test_spans_never_overlap(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    found = find_mentions(spark, docs.select("doc_id", "text"), PEOPLE).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert all(re.search(r"\w", r["mention"]) for r in found)


def test_sure_patterns_find_han_names_and_streets_that_no_list_holds(spark):
    people = [("伟", "张"), ("芳", "王"), ("Mary", "Quill")]
    texts = [f"计算由张伟负责,第{i}批" for i in range(12)] + [f"计算由王芳负责,第{i}批" for i in range(12)]
    texts += ["计算由司马娜负责,第一批", "计算由秦岭负责,第二批", "计算由于内存不足停止"]
    texts += [f"Send it to {i} Alder Street, Oxford OX1 2AB before noon" for i in range(1, 15)] + ["Send it to 12 Quenby Mews, Oxford OX1 2AB before noon", "Run 3 Quantum Steps then stop"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {(r["doc_id"], r["kind"], r["mention"]) for r in find_mentions(spark, docs, people).collect()}
    assert (24, "name", "司马娜") in found and (25, "name", "秦岭") in found
    assert not any(d == 26 for d, _, _ in found)
    assert (41, "address", "12 Quenby Mews") in found and not any(d == 42 for d, _, _ in found)

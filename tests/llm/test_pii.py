import math
import random
import re
from collections import Counter

import pytest

from tidewatch.llm import pii
from tidewatch.llm.queries import op5_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: "".join(re.findall("[0-9]", s))
    text = text or ""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_plain_patterns():
    random.seed(3)
    for alphabet in ("ab1290.@-+ ()%_é", "0123456789 -", "1.2@a_b", "+1 (2)3-4"):
        for _ in range(20_000):
            text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
            assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1.1." * 50_000, "+" * 100_000 + "+1 " + " " * 100_000):
        pii.base_spans(text)


def test_edges(spark, edge, empty):
    got = [(r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in pii.find_personal_data(edge, keep=("doc_id", "text")).collect()]
    assert sorted(got, key=repr) == sorted(((r.doc_id, r.text, sorted(brute(r.text))) for r in edge.collect()), key=repr)
    assert pii.find_personal_data(empty).count() == 0


def test_disclosing_terms_are_found_from_the_corpus(spark):
    rows = [(i, f"note {'abcdefgh'[i]}xx quarterback Zanzibar writes to ann@example.org about the {'pqrstuvw'[i]}yy budget") for i in range(5)]
    rows += [(10 + i, "copy of one text with plimsoll and bob@example.org in it") for i in range(6)]
    rows += [(100 + i, f"about the budget and the note of day {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {r.text[s.start : s.end] for s in r.spans if s.kind == 4} for r in pii.find_personal_data(docs, keep=("doc_id", "text")).collect()}
    assert got[0] == {"quarterback", "Zanzibar", "writes"}  # common words stay
    assert all(not got[10 + i] for i in range(6))  # copies are one context
    assert not any(got[100 + i] for i in range(400))
    clean = {r.doc: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "note axx  [NAME]  to [EMAIL] about the pyy budget"
    assert clean[100] == rows[11][1]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in op5_pii(spark, sf_dir).collect():
        want = brute(texts[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        spans = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(want)]
        assert [s for s in row.spans.split(",") if s and not s.startswith("term")] == spans


def _filler(i):
    return (1000 + i, f"about the budget and the note of day {i}")


def test_terms_are_measured_and_masked_in_the_whole_text(spark):
    rng = random.Random(6)
    between = lambda: " ".join(rng.sample([f"filler{j}" for j in range(60)], 60))  # noqa: E731  another order each time, so no near copies
    rows = [(i, f"Zanzibar {between()} day {'abcdefgh'[i]}{'pqrstuvw'[i]}z Zanzibar writes to ann@example.org {between()} so zanzibar says") for i in range(5)]
    rows += [(10 + i, f"{between()} nothing {i}") for i in range(100)] + [_filler(i) for i in range(400)]
    far = [(20 + 100 * i, f"Plimsoll {between()} {'abcdefgh'[i]}yx bob@example.org {between()}") for i in range(1, 5)]
    docs = spark.createDataFrame(rows + far, "doc_id long, text string")
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == 4] for r in pii.find_personal_data(docs, keep=("doc_id", "text")).collect()}
    assert got[0] == ["Zanzibar", "Zanzibar", "writes", "zanzibar", "says"]
    assert all(got[i] == ["Plimsoll"] for i, _ in far)


def test_copies_do_not_lower_the_disclosure(spark):
    rows = [(i, f"day {'abcdefgh'[i]}xx Zanzibar writes to ann@example.org") for i in range(3)]
    rows += [(10 + i, rows[0][1]) for i in range(300)] + [_filler(i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: {r.text[s.start : s.end] for s in r.spans if s.kind == 4} for r in pii.find_personal_data(docs, keep=("doc_id", "text")).collect()}
    assert got[0] == got[10] == got[309] == {"Zanzibar", "writes"}


def test_all_ways_to_count_terms_agree(spark):
    rows = [(i, f"alpha {'beta ' * (i % 3 == 0)}gamma{i % 7} x{i % 5}{'@' * (i % 4 == 1)}example.org") for i in range(60)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = {t for _, t in rows if t}
    want = {t: sum(t in pii.terms_of(x, []) for x in texts if not pii.base_spans(x)) for t in ("alpha", "beta", "gamma1")}
    terms = spark.createDataFrame([(t,) for t in [*want, "example"]], "term string")
    repeated = docs.groupBy(pii._copy("text")).count().where("count > 1").select("copy")
    for limits in ((9, 10**6), (9, 0), (1, 10**6), (1, 0)):
        assert {r.term: r.n_t for r in pii.documents_with(docs, "text", terms, repeated, *limits).collect()} == want


def _expected(rows, threshold=0.6, support=3):
    """Added spans of every text by plain counting over different texts."""
    texts = {t: (pii.names_of(t, brute(t)), {x for x, _, _ in pii.places(t.translate(LOWER), brute(t)) if len(x) > 2 and any(c.isalpha() for c in x)}) for t in {t for _, t in rows if t}}
    context = {}  # near copies among texts with an entity: whatever shares a mark, directly or not
    for text in (t for t, (names, _) in texts.items() if names):
        same = {text}.union(*(context[m] for m in pii.near_marks(text) if m in context))
        context.update((m, same) for t in same for m in pii.near_marks(t))
    groups = {id(s): s for s in context.values()}.values()
    units = [(set().union(*(texts[t][0] for t in g)), set().union(*(texts[t][1] for t in g)), {(e, x) for t in g for e in texts[t][0] for x in texts[t][1]}) for g in groups]
    units += [((), terms, ()) for names, terms in texts.values() if not names]
    n, n_e, n_t, n_et = len(units) + any(not t for _, t in rows), Counter(), Counter(), Counter()
    for names, terms, both in units:
        n_e.update(names)
        n_t.update(terms)
        n_et.update(both)
    lower = lambda k: k * (1 - 1 / (9 * k) - 1.645 / (3 * math.sqrt(k))) ** 3
    bad = {(e, t) for (e, t), k in n_et.items() if k >= support and math.log(n * lower(k) / (n_e[e] * n_t[t])) / max(math.log(n / n_e[e]), 1e-9) >= threshold}
    return {text: [(a, b) for t, a, b in pii.places(text.translate(LOWER), brute(text)) if any((e, t) in bad for e in names)] for text, (names, _) in texts.items()}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("Zanzibar", "Plimsoll", "Quarterback", "Wisteria", "Oxbow", "Kestrel", "Juniper", "Larkspur")


def _planted(rng):
    """Texts with single values whose class a planted name gives away, among many others."""
    words = [a + b for a in ("ta", "mi", "so", "re", "ku", "lo") for b in ("nd", "rk", "st", "lm", "vo", "pe", "xi")]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    rows = []
    for i, name in enumerate(NAMES):
        for j in range(8):
            value = (f"p{j}@clinic{i}.example", f"10.{i}.7.{j + 1}", f"+{200 + i} 555 01{j}{j} 77", f"user{j}.{i}@ward.example{i}.org")[i % 4]
            rows.append(f"{prose(30)} {name} {prose(40)} {value} {prose(30)}")
    rows += [f"{prose(60)} q{j}@mail{j % 5}.example.com {prose(20)}" for j in range(60)]
    return rows + [f"{prose(80)} {j}" for j in range(400)]


@pytest.mark.parametrize("copies", [1, 10, 100])
def test_planted_terms_are_found_whatever_the_copies(spark, copies):
    """All planted names are found, no word of the prose, and the spans are those of plain counting."""
    rows = _planted(random.Random(2))
    many = [*rows, *rows[:: len(rows) // 20] * (copies - 1), *[rows[0]] * (copies - 1)]
    rows = list(enumerate(many))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in pii.find_personal_data(docs).collect()}
    want = _expected(rows)
    assert got == {i: want[t] for i, t in rows}
    found = [{t[a:b] for a, b in got[i]} for i, t in rows[: 8 * len(NAMES)]]
    planted = [NAMES[i // 8] for i in range(8 * len(NAMES))]
    assert sum(n in f for n, f in zip(planted, found)) >= 0.9 * len(planted)
    assert sum(t[a:b] not in NAMES for i, t in rows for a, b in got[i]) <= 0.1 * len(planted)


def test_near_copies_are_one_text(spark):
    """A group of near copies alone discloses nothing, and does not hide what other texts disclose."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    origin = [word() for _ in range(120)]
    near = [" ".join(w if rng.random() > 0.01 else word() for w in origin) + " Zanzibar writes ann@clinic.example" for _ in range(80)]
    rows = near + [f"{' '.join(word() for _ in range(60))} Zanzibar, {word()} p{j}@clinic.example" for j in range(5)] + [" ".join(word() for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in pii.find_personal_data(docs).collect()}
    want = _expected(rows)
    assert got == {i: want[t] for i, t in rows}
    assert all({t[a:b] for a, b in got[i]} == ({"Zanzibar"} if "@" in t else set()) for i, t in rows)


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a@b.example", "x", "y")], "row long, text string, spans string, hits string")
    (row,) = pii.find_personal_data(docs, keep=("row", "spans", "hits")).collect()
    assert (row.row, row.hits, [tuple(s) for s in row.spans]) == (1, "y", [(0, 0, 11)])


def test_sanitise_with_overlapping_spans_nulls_and_repeated_rows(spark):
    rows = [(1, "card 4111 1111 1111 1111@x.example end"), (1, None), (2, ""), (2, ""), (None, "ip 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc, r.text) for r in pii.sanitise(docs).collect()), key=repr)
    assert got == sorted([(1, "card [CARD] end"), (1, None), (2, ""), (2, ""), (None, "ip [IP]")], key=repr)

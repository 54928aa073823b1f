"""Operators against brute force on small fixtures, with the odd cases of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, line_crf, line_dedup, mixing, ngram_lm, packing, pii, quality_rules, simhash, vector_search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, score string, row string, block string, h string, n_lines string, id string"
LONG = "word " * 30_000


def frame(spark, rows):
    """(doc_id, text, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], DOCS)


ODD = [(1, None, None), (2, "", ""), (3, " \n\t ", "b"), (None, "a few words here", "b"), (4, "same text twice", "a"), (4, "same text twice", "a"), (5, LONG, "a"), (6, "same text twice", None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def water(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    w = [weights[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        left, rest = share * sum(sizes) - sum(limit * sizes[i] for i in capped), sum(x for i, x in enumerate(w) if i not in capped)
        t = [limit * s if i in capped else left * w[i] / rest for i, s in enumerate(sizes)]
        over = {i for i, x in enumerate(t) if x > limit * sizes[i]}
        if not over:
            return t
        capped |= over


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice((1, 3, 20, 50, rng.randint(1, 400))), rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", None])) for i in range(4000)]
    rows += [(9000 + i, None, "empty") for i in range(3)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, None, 0])
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        b = by[r.source]
        b[0], b[1], b[2], b[3] = b[0] + r.size, b[1] + r.taken, r.target, r.source_size
    order = sorted((k for k in by if k is not None), key=lambda k: k.encode()) + [None]
    for k, t in zip(order, water([by[k][0] for k in order])):
        assert by[k][3] == by[k][0] and by[k][2] == pytest.approx(t)
        assert abs(by[k][1] - t) <= 2 * 400 + 0.02 * t
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_mixing_with_clashing_names(spark):
    names = "before l b p c_source t_source c_cell cell n s rank copies key id part length lead words source_size target place weight cap total level water __rank __copies __cell __key".split()
    plain = spark.createDataFrame([(i, "w " * (i % 50), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    wide = plain.select("*", *[F.lit("x").alias(n) for n in names])
    want = Counter(tuple(r) for r in mixing.mix_sources(plain).select("doc_id", "taken", "target").collect())
    for keep_text in (True, False):
        got = mixing.mix_sources(wide, keep_text=keep_text)
        assert Counter(tuple(r) for r in got.select("doc_id", "taken", "target").collect()) == want
        assert ("text" in got.columns) == keep_text and {r["__rank"] + r["b"] + r["__cell"] for r in got.collect()} == {"xxx"}
    assert mixing.take_mix(wide).columns == wide.columns


def test_mixing_odd_rows(spark):
    got = mixing.mix_sources(frame(spark, ODD))
    assert got.count() == len(ODD) and {r.source_size for r in got.where("source = 'a'").collect()} == {30_006}
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    taken = mixing.take_mix(frame(spark, ODD))
    assert taken.columns == frame(spark, []).columns


# 2


def brute_scores(rows, order, mass):
    docs = [(i, (t or "").encode().lower().split() + [None], h) for i, t, h in rows]
    c = Counter()
    for _, t, h in docs:
        if not h:
            s = ["<s>", *t]
            c[("<s>",)] += 1
            for p in range(1, len(s)):
                for k in range(1, min(order, p + 1) + 1):
                    c[tuple(s[p - k + 1 : p + 1])] += 1
    uni = {k[0]: v for k, v in c.items() if len(k) == 1 and k[0] != "<s>"}
    n, v = sum(uni.values()), len(uni)

    def p(w, h):
        if not h:
            return (uni.get(w, 0) + 1) / (n + v + 1)
        return (c.get((*h, w), 0) + mass[len(h) - 1] * p(w, h[1:])) / (c.get(h, 0) + mass[len(h) - 1])

    for i, t, h in docs:
        s = ["<s>", *t]
        base = sum(math.log10(p(w, ())) for w in t)
        yield i, (h, len(t), sum(uni.get(w, 0) > 0 for w in t), n), base, sum(math.log10(p(s[q], tuple(s[max(0, q - order + 1) : q]))) for q in range(1, len(s)))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_formula(spark, order):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the cat sat on mat And É x".split()) for _ in range(rng.randint(0, 700))), None) for i in range(40)] + [(50, None, None), (51, "never seen", None)]
    mass = (7.0, 3.0)
    got = ngram_lm.score_texts(frame(spark, rows), F.col("doc_id") % 5 == 1, order=order, mass=mass, block_bytes=9000).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, exact, base, score in brute_scores([(i, t, i % 5 == 1) for i, t, _ in rows], order, mass):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == exact
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_scores_count_equal_rows_each(spark):
    rows = [(1, "a b c a", None)] * 5 + [(None, "a b", None)] * 4 + [(2, "c d", None), (6, "a a", None), (6, "a a", None)]
    got = ngram_lm.score_texts(frame(spark, rows).coalesce(1), F.col("doc_id") == 6, mass=(7.0,))
    want = Counter((i, exact, round(score, 9)) for (i, t, _), (_, exact, _, score) in zip(rows, brute_scores([(i, t, i == 6) for i, t, _ in rows], 2, (7.0,))))
    assert Counter((r.doc_id, (r.held_out, r.n_tokens, r.n_known, r.train_tokens), round(r.score, 9)) for r in got.collect()) == want


def test_scores_of_odd_rows(spark):
    got = ngram_lm.score_texts(frame(spark, ODD), F.col("doc_id") == 5)
    assert got.count() == len(ODD) and got.where("score > 0 or score is null").count() == 0
    assert ngram_lm.score_texts(frame(spark, []), F.lit(False)).count() == 0
    unlearnt = ngram_lm.score_texts(frame(spark, ODD[:3]), F.lit(True)).collect()
    assert {(r.train_tokens, r.score) for r in unlearnt} == {(0, 0.0)}


# 3


def brute_fingerprint(text):
    import xxhash

    ws = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_cells_find_all_links():
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(25):
        base = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(10):
            x = base
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps)
    place = {f: i for i, f in enumerate(fps)}
    for t, most in ((0, 1 << 20), (0, 2000), (6, 400)):
        bits = simhash.ROUTE[:t]
        route = sum(1 << b for b in bits)
        one, two = simhash._routes(bits)
        cells = defaultdict(list)
        for f in fps:
            for d in one if f.bit_count() % 2 else one + two:
                cells[f & route ^ d].append(f)
        a, b = [], []
        for cell, members in cells.items():
            for x, y in zip(*simhash.cell_links(np.array(members, dtype=np.uint64), bits, cell, most)):
                a.append(place[int(x)])
                b.append(place[int(y)])
        assert simhash._forest(len(fps), np.array(a, dtype=int), np.array(b, dtype=int)).tolist() == want


def test_simhash_groups(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(300)] for _ in range(6)]
    rows = list(ODD)
    for i in range(60):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(300)] = "new"
        rows.append((100 + i, " ".join(ws).title(), "s"))
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    groups = defaultdict(list)
    for i, k in enumerate(brute_components(fps)):
        groups[k].append(i)
    want = Counter()
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        want.update((rows[i][0], f"{fps[i]:016x}", least) for i in members)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert len(kept) == len(groups)
    label = brute_components(fps)
    root = {(i, t): label[n] for n, (i, t, _) in enumerate(rows)}
    assert sorted(root[r.doc_id, r.text] for r in kept) == sorted(groups)  # one row of each component, null ids included
    assert Counter(r.doc_id for r in kept) == Counter(min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for m in groups.values())


def test_drop_near_duplicates_keeps_one_row_of_each_component(spark):
    rng = random.Random(16)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(300)) for _ in range(7)]
    fps = [brute_fingerprint(t) for t in texts]
    assert len(set(brute_components(fps))) == len(texts)
    rows = [(None, t, "s") for t in texts[:4] for _ in range(2)]  # components of null ids only
    rows += [(1, texts[4], "s"), (2, texts[4], "s"), (2, texts[5], "s"), (3, texts[5], "s"), (2, texts[6], "s"), (None, texts[6], "s")]
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, t) for t in texts[:4]] + [(1, texts[4]), (2, texts[5]), (2, texts[6])])


def test_drop_near_duplicates_of_odd_tables(spark):
    apart = [" ".join(f"{w}{i}{j}" for j in range(40) for w in ("ab", "cd")) for i in range(5)]
    rows = [(7, apart[0]), (7, apart[1]), (None, apart[2]), (None, apart[3]), (None, apart[4]), (7, apart[1])]
    named = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, key1 string, __stay1 string, fp string")
    kept = simhash.drop_near_duplicates(named)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(set(rows)) and kept.columns == named.columns
    assert simhash.drop_near_duplicates(named.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}


# 4


def test_chat_round_trip(spark):
    rng = random.Random(5)
    scraps = ["<|im_end|>", "<|im_start|>user\n", "</s>", "[INST]", "[\\/INST]", "<\\\\s>", "\\", "é", "\n", "<", "|", "ok ", "\\n"]
    rows, want = [], defaultdict(list)
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "sys\ntem\\n", "[INST]"])
            rows.append((conv, turn, role, "".join(rng.choice(scraps) for _ in range(rng.randint(0, 30)))))
            want[conv].append(rows[-1][2:])
    rows += [(77, 0, None, None), (77, 1, "assistant", "x" * 200_000), (77, 1, "assistant", "x" * 200_000)]
    want[77] = [("", ""), *[("assistant", "x" * 200_000)] * 2]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_conversations(turns)
    assert {r.conv_id: chat.read_back(r.formatted) for r in got.collect()} == dict(want)
    for r in chat.digest(got).collect():
        said = want[r.conv_id]
        under = "".join(t for role, t in said if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(under), hashlib.sha256(under.encode()).hexdigest())
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_in_portions(spark, monkeypatch):
    import pyarrow as pa

    turns = [(i // 3, i % 3, ("user", "assistant", None)[i % 3], "é<" * (i % 17)) for i in range(60)] + [(None, 0, "user", "z" * 300), (None, 1, "assistant", None)]
    table = pa.table([pa.array(c) for c in zip(*turns)], names=["conv_id", "turn", "role", "text"])
    whole = pa.Table.from_batches([chat.assemble(table)])
    for size in (1, 50, 400):
        monkeypatch.setattr(chat, "PORTION", size)
        parts = list(chat.portions(table))
        assert len(parts) > 1 and sum(p.num_rows for p in parts) == table.num_rows
        assert pa.Table.from_batches(list(map(chat.assemble, parts))).equals(whole)


# 5

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if fits[k](m[0])] for k, p in PATTERNS.items()}


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        letters = rng.choice(["a@.-1", "@a.b", "1.25", "+1 (2)-.", "0123456789 -", "a1@.+ -(\n", "4111 "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 200_000)["ip"] == [] and pii.base_spans("a" * 200_000 + "@")["email"] == []


def test_field_adds_what_is_spelt_elsewhere(spark):
    text = "pay 4366826422043230 é then 4366.8264.2204.3230; call +1 (886) 555-7964, that is 18865557964 not 12345678901"
    _, spans = pii.find_spans(text)
    got = {(k, text[s:e]) for k, s, e in spans}
    assert got == {("card", "4366826422043230"), ("card", "4366.8264.2204.3230"), ("phone", "+1 (886) 555-7964"), ("phone", "18865557964")}
    clean = "on 2024-01-02 build 18865557964 took 12.5 s at 10:30, see 4.4.2"
    assert pii.find_spans(clean)[1] == []
    found = pii.find_personal_data(frame(spark, [*ODD, (9, text, "a")])).collect()
    assert len(found) == len(ODD) + 1
    row = next(r for r in found if r.doc_id == 9)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (0, 0, 1, 1)
    assert row.base_sha256 == hashlib.sha256(b"card:4:20,phone:54:71").hexdigest()
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_field_needs_the_support_of_a_base_span():
    plain = [
        "call 18865557964 or later 18865557964 again and 18865557964", "host 10.0.0.1 on 2024-01-02 and again 2024-01-02", "order 20240102-55 twice 20240102-55, mail a@b.org",
        "no Luhn 1234567812345678 1234567812345678 1234567812345678 x@y.zz", "a@b a@b a@b 1.2.3.4 " * 40, "20240102 20240102 " * 300 + "+1 (886) 555-7964",
    ]
    for text in plain:
        base, spans = pii.find_spans(text)
        assert len(spans) == sum(map(len, base.values())), text
    with pytest.raises(ValueError):
        pii.Potentials(weak=1.0)
    long = "x" * 500 + "18865557964"
    text = f"+1 (886) 555-7964 {long}"
    assert ("phone", 18, 18 + len(long)) in pii.find_spans(text)[1]  # tokens of any length


def test_shortcut_changes_no_result():
    rng = random.Random(18)
    p, scraps = pii.Potentials(), ["18865557964", "+18865557964", "4366826422043230", "4366.8264.2204.3230", "2024-01-02", "a@b.org", "A@B", "10.0.0.1", "20240102-55", "0018865557964"]
    for _ in range(400):
        text = " ".join(rng.choice(scraps) for _ in range(rng.randint(0, 14)))
        base = pii.base_spans(text)
        nodes, unary, edges, weights, supported = pii.field_of(text, base, p)
        found = pii._marginals(unary, edges, weights, p.rounds) if nodes else []
        slow = [(pii.KINDS[int(m.argmax()) - 1], s, e) for (s, e, label), m in zip(nodes, found) if not label and m.argmax() and m.max() > 0.5]
        assert slow == pii.added_spans(text, base, p)
        assert supported or not slow


def test_loopy_marginals_are_near_enumeration():
    """On loops sum-product is not exact; verdicts agree with those of all labellings."""
    from itertools import product

    p = pii.Potentials()
    for text in ("18865557964 18865557964 +18865557964", "4366.8264.2204.3230 4366826422043230 4366.8264.2204.3230", "2024-01-02 2024-01-02 2024-01-02 10.0.0.1", "+18865557964 20240102 18865557964 20240102"):
        nodes, unary, edges, weights, _ = pii.field_of(text, pii.base_spans(text), p)
        n, total = len(nodes), np.zeros(unary.shape)
        for ys in product(range(5), repeat=n):
            total[range(n), ys] += math.exp(sum(unary[i, y] for i, y in enumerate(ys)) + sum(w for (a, b), w in zip(edges, weights) if ys[a] == ys[b] > 0) - 60)
        exact = total / total.sum(axis=1, keepdims=True)
        found = pii._marginals(unary, edges, weights, p.rounds)
        assert (exact.argmax(axis=1) == found.argmax(axis=1)).all() and np.abs(exact - found).max() < 0.1


def test_field_equals_enumeration_of_a_tree():
    from itertools import product

    rng = np.random.default_rng(17)
    unary, edges, weights = rng.normal(size=(4, 5)) * 2, np.array([[0, 1], [1, 2], [1, 3]]), np.array([0.2, 4.0, 4.0])
    total = np.zeros((4, 5))
    for ys in product(range(5), repeat=4):
        p = math.exp(sum(unary[i, y] for i, y in enumerate(ys)) + sum(w for (a, b), w in zip(edges, weights) if ys[a] == ys[b] > 0))
        total[range(4), ys] += p
    assert np.allclose(pii._marginals(unary, edges, weights, 12), total / total.sum(axis=1, keepdims=True))


# 6


def brute_measures(text):
    ws, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_their_definitions(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "# ", "é|", "a b c ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = ODD + [(100 + i, t, "s") for i, t in enumerate(texts)]
    got = quality_rules.quality_rules(frame(spark, rows))
    want = Counter((i, *brute_measures(t)) for i, t, _ in rows)
    found = got.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def test_words_with_a_letter(spark):
    texts = ["a1 12 é- 漢 -- \t\n b", "", None, "7" * 300000, "1a2 " * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(quality_rules.letter_words(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [sum(any(c.isalpha() for c in w) for w in (t or "").split()) for t in texts]


def test_rule_order_is_rejection_per_cost(spark):
    rows = frame(spark, [(i, "w " * i, "s") for i in range(80)])
    measured = quality_rules.measure(rows)
    rules = [quality_rules.Rule("never", F.col("n_words") < 0), quality_rules.Rule("often", F.col("n_words") < 70)]
    assert [r.name for r in quality_rules.order_rules(measured, rules)] == ["often", "never"]


def test_later_rules_are_not_worked_out(spark):
    """A rule that fails the query where it is worked out, after one that rejects the same rows."""
    rows = frame(spark, [(i, "w " * i, "s") for i in range(60, 90)])
    first = quality_rules.Rule("first", F.col("n_words") < 75)
    bomb = quality_rules.Rule("bomb", F.when(F.col("n_words") < 75, F.raise_error(F.lit("worked out")).cast("boolean")).otherwise(F.lit(False)))
    measured = quality_rules.measure(rows)
    assert measured.where(quality_rules.cascade_of([first, bomb])).count() == 15
    with pytest.raises(Exception, match="worked out"):
        measured.where(quality_rules.cascade_of([bomb, first])).count()


def test_costly_rules_come_after_cheap_ones_that_reject_as_much(spark):
    rows = frame(spark, [(i, " ".join(f"word{j}" for j in range(i % 100 + 900)), "s") for i in range(300)])
    measured, inner = quality_rules._measured(rows, "text")
    costly = F.size(F.array_distinct(F.transform(inner[1], lambda w: F.sha2(F.sha2(F.sha2(w, 512), 512), 512))))
    rules = [quality_rules.Rule("a_costly", (F.col("n_words") < 950) & (costly > 0)), quality_rules.Rule("b_cheap", F.col("n_words") < 950)]
    assert [r.name for r in quality_rules.order_rules(measured, rules)] == ["b_cheap", "a_costly"]


def test_method_rules(spark):
    plain = " ".join(f"word{i}" for i in range(120))
    ten = lambda form: "\n".join(form.format(i) for i in range(12))
    texts = {
        "plain": (plain, True), "list": (ten("- item{0} of the list with words{0} and more{0}"), False), "broken": (ten("line{0} of a page that goes on{0} to ..."), False),
        "few": ("yes no " * 60, False), "lines": ("\n".join(plain.split()), True), "short list": ("- " + plain, True), "breaks once": (plain + "\nmore…", True),
    }
    rows = frame(spark, [(i, t, "s") for i, (t, _) in enumerate(texts.values())])
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(rows).collect()}
    assert got == {i: kept for i, (_, kept) in enumerate(texts.values())}


def test_quality_rules_replace_their_own_columns(spark):
    rows = frame(spark, ODD).withColumns({"kept": F.lit("x"), "Base_Failed": F.lit("y"), "n_words": F.lit("z"), "words": F.lit("w"), "__low": F.lit("v")})
    got = quality_rules.quality_rules(rows)
    assert len(set(map(str.lower, got.columns))) == len(got.columns) and {(type(r.kept), r.words, r["__low"]) for r in got.collect()} == {(bool, "w", "v")}


# 7


def test_best_fit_equals_one_by_one():
    rng = random.Random(8)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        runs = packing.best_fit_runs(counts, 64)
        bins = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                best = min((i for i, left in enumerate(bins) if left >= n), key=lambda i: bins[i], default=None)
                if best is None:
                    bins.append(64 - n)
                else:
                    bins[best] -= n
        filled = defaultdict(list)
        for n, rank, k, first, offset in runs.tolist():
            for j in range(k):
                filled[first + j].append((offset, n))
        assert len(filled) == len(bins)
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 64
        for n in counts:
            ranks = sorted((r, k) for m, r, k, _, _ in runs.tolist() if m == n)
            assert [r for r, _ in ranks] == np.cumsum([0, *[k for _, k in ranks]])[:-1].tolist() and sum(k for _, k in ranks) == counts[n]


def test_token_ids_equal_the_tokenizers_on_hostile_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder("byte_bpe_50k").encode
    rng = random.Random(32)
    scraps = ["'s", "'LL", "  ", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "é", "e\u0301", "数字", "٣٤", "한국어", "Ⅷ", "½", "👩‍👩‍👧", "\ud7ff", "\x00", "<|endoftext|>", "word", "Word", "123", "4567890", "_", "...", "!?", "ſ", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(scraps) for _ in range(rng.randint(0, 12)))
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_pack_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = ["don't  stop\n\n now ", "<|endoftext|> x <|endoftext|>", "数字 ٣٤ 한국어 é  ñ", "a b  c", "\x1c \x85 x"]
    rows = ODD + [(100 + i, t, "s") for i, t in enumerate(texts)] + [(200 + i, "tok " * rng.randint(1, 900), "s") for i in range(60)]
    got = packing.pack_documents(frame(spark, rows), capacity=256).collect()
    whole, places = Counter(), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert whole == want
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack_documents(frame(spark, [])).count() == 0


# 8


def test_line_dedup_catches_passages_and_spares_the_rest(spark):
    rng = random.Random(10)
    line = lambda a, b: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(a, b)))
    passages = ["\n".join(line(12, 30) for _ in range(rng.randint(3, 6))) for _ in range(8)] + [line(55, 90) for _ in range(4)]
    licence = "all rights of this text are with those who wrote it"
    rows, own = [], {}
    for i in range(72):
        lines = [line(3, 20) for _ in range(rng.randint(1, 8))] + [licence]
        rng.shuffle(lines)
        own[i] = lines
        at = rng.randint(0, len(lines))
        rows.append((i, "\n".join(lines[:at] + passages[i % 12].split("\n") + lines[at:]), "s"))
    got = line_dedup.dedup_lines(frame(spark, rows), bucket_bytes=9000).collect()
    left = {r.doc_id: r.text.split("\n") for r in got}
    for k, p in enumerate(passages):
        assert [sum(x in left[i] for x in p.split("\n")) for i in range(k + 12, 72, 12)] == [0] * 5
        assert "\n".join(left[k]).count(p) == 1
    assert all(x in left[i] for i, lines in own.items() for x in lines if x != licence)
    assert sum(licence in x for x in left.values()) > 36  # it goes only where it is next to the same passage
    assert all(r.n_removed == r.n_lines - len(r.text.split("\n")) for r in got)


def test_line_dedup_odd_rows(spark):
    twins = [(20, "one line\n" + "w " * 60, "s"), (21, "w " * 60, "s"), (20, "one line\n" + "w " * 60, "s")]
    got = line_dedup.dedup_lines(frame(spark, ODD + twins)).collect()
    assert len(got) == len(ODD) + 3
    assert {r.doc_id: r.text for r in got}[1] is None and [r.text for r in got if r.doc_id == 21] == [""]
    assert len({r.text for r in got if r.doc_id == 20}) == 1
    assert sorted(r.text for r in got if r.doc_id == 4) == ["same text twice"] * 2
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_line_dedup_joins_short_lines(spark, n):
    rng = random.Random(20 + n)
    line = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(k))
    passages = [[line(n) for _ in range(-(-54 // n))] for _ in range(10)]
    rows, own = [], {}
    for i in range(50):  # earlier documents have the lines of passages singly or in pairs of less than 16 words
        rows.append((i, "\n".join(x for p in passages for x in (line(20), p[i % len(p)])), "s"))
    for i in range(100, 150):
        own[i] = [line(5) for _ in range(4)]
        rows.append((i, "\n".join(own[i][:2] + passages[i % 10] + own[i][2:]), "s"))
    left = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(frame(spark, rows), bucket_bytes=9000).collect()}
    for i in range(100, 110):
        assert left[i] == own[i][:2] + passages[i % 10] + own[i][2:]
    for i in range(110, 150):
        assert left[i] == own[i]


def test_line_dedup_joins_long_lines_that_stand_apart_elsewhere(spark):
    a, b = " ".join(["alpha"] * 30), " ".join(["beta"] * 30)
    rows = [(1, f"x\n{a}\ny", "s"), (2, f"z\n{b}\nw", "s"), (5, f"p\n{a}\n{b}\nq", "s"), (9, f"r\n{a}\n{b}\ns", "s")]
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert left == {i: t for i, t, _ in rows[:3]} | {9: "r\ns"}


def test_line_dedup_keeps_the_first_of_overlapping_occurrences(spark):
    got = line_dedup.dedup_lines(frame(spark, [(1, "\n".join(["same"] * 40), "s"), (2, "\n".join(["same"] * 15), "s")])).collect()
    assert {r.doc_id: r.text.count("same") for r in got} == {1: 16, 2: 15}


def test_cuts_do_not_shift():
    rng = random.Random(24)
    for _ in range(50):
        passage = [b" ".join(b"%d" % rng.randint(0, 99) for _ in range(rng.randint(5, 12))) for _ in range(40)]
        inside = set()
        for k in (0, 1, 3, 8):
            lines = [b"before %d %d" % (k, i) for i in range(k)] + passage + [b"after %d" % i for i in range(k)]
            spans = line_dedup.cut_lines(lines, [len(x.split()) for x in lines])
            cuts = frozenset((a - k, b - k) for a, b in spans if a - k > 4 and b - k < 40)
            inside.add(cuts)
        assert len(inside) == 1 and any(b - a > 1 for a, b in inside.pop())


def test_line_dedup_removes_all_repeated_runs(spark):
    """Against brute force: a line goes if it lies in a run of several lines and 16 words, or is a line of 50, that stands earlier too."""
    rng = random.Random(25)
    pool = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 20, 30, 55]))) for _ in range(60)]
    rows = []
    for i in range(60):
        lines: list[str] = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(60)
            lines += pool[at : at + rng.randint(1, 6)] if rng.random() < 0.7 else [f"own {i} {rng.random()}"]
        rows.append((i, "\n".join(dict.fromkeys(lines)), "s"))  # no line twice in a text
    texts = [t.split("\n") for _, t, _ in rows]
    size = lambda ls: sum(len(x.split()) for x in ls)
    seen, want = set(), {}
    for i, lines in enumerate(texts):
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if size(lines[a:b]) >= (16 if b - a > 1 else 50)]
        gone = {k for a, b in runs if tuple(lines[a:b]) in seen for k in range(a, b)}
        want[i] = [x for k, x in enumerate(lines) if k not in gone]
        seen |= {tuple(lines[a:b]) for a, b in runs}
    got = {r.doc_id: r.text.split("\n") if r.text else [] for r in line_dedup.dedup_lines(frame(spark, rows), bucket_bytes=2000).collect()}
    assert got == want and sum(map(len, want.values())) < sum(map(len, texts))


def test_line_dedup_of_equal_rows_and_very_many_lines(spark):
    many = "\n".join(f"line number {i} of many" for i in range(60_000))
    rows = [(1, many, "s"), (2, many + "\nown", "s")] + [(None, "the same\nwords " + "w " * 20, "s")] * 30
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == Counter({(1, many, 60_000, 0): 1, (2, "own", 60_001, 60_000): 1, (None, rows[-1][1], 2, 0): 30})


def test_stretches_equal_their_definition():
    rng = random.Random(15)
    for _ in range(500):
        lines = [b"w " * rng.choice([0, 0, 1, 2, 5, 17, 30]) for _ in range(rng.randint(0, 25))]
        full = [i for i, x in enumerate(lines) if x]
        fits = {(a, b + 1) for a in full for b in full if a < b and sum(len(x.split()) for x in lines[a : b + 1]) >= 16}
        least = {(a, b) for a, b in fits if not any((a, c) in fits for c in range(b))} | {(a, b) for a, b in fits if not any((c, b) in fits for c in range(a + 1, b))}
        assert line_dedup.stretches([len(x.split()) for x in lines]) == least


# 9


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(11)
    unary, lengths, move = rng.normal(size=(4, 5)), np.array([5, 1, 3, 2]), rng.normal(size=(2, 2))
    good, pairs = line_crf.marginals(unary, lengths, move)
    for d, n in enumerate(lengths):
        total, p, e = 0.0, np.zeros(5), np.zeros((2, 2))
        for ys in product((0, 1), repeat=int(n)):
            w = math.exp(sum(unary[d, i] for i, y in enumerate(ys) if y) + sum(move[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            for i, y in enumerate(ys):
                p[i] += w * y
            for a, b in zip(ys, ys[1:]):
                e[a, b] += w
        assert np.allclose(good[d], p / total) and np.allclose(pairs[d], e / total)


def test_document_scores_equal_enumeration(monkeypatch):
    from itertools import product

    rng = np.random.default_rng(19)
    model = line_crf.Model(rng.normal(size=49) / 9, 1 + rng.random(49), rng.normal(size=49), rng.normal(size=(2, 2)), 1.3, -0.2)
    texts = [b"", b"one line.", b"a b c\n\nd e 1 2\na b c", b"x\n" * 6, b"#|#\nWords In Line\nwords words words words words\n\nx"]
    want = []
    for text in texts:
        x = line_crf.chain_features(text)
        unary = (x - model.mean) / model.scale @ model.weights
        total, good = 0.0, np.zeros(len(x))
        for ys in product((0, 1), repeat=len(x)):
            w = math.exp(sum(u for u, y in zip(unary, ys) if y) + sum(model.move[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            good += w * np.array(ys)
        size = np.array([len(line) + 1 for line in text.split(b"\n")])
        m = good @ size / total / size.sum()
        want.append(1 / (1 + (m / (1 - m)) ** -1.3 * math.exp(0.2)))
    for long_lines, piece, cells in ((2048, 4096, 1 << 16), (2, 3, 8)):
        for name, value in (("LONG_LINES", long_lines), ("PIECE", piece), ("GROUP_CELLS", cells)):
            monkeypatch.setattr(line_crf, name, value)
        assert np.allclose(model.document_scores(texts), want)


def test_scores_of_texts_of_very_many_lines():
    model = line_crf.Model(np.zeros(49), np.ones(49), np.linspace(-1, 1, 49), np.eye(2), 1.0, 0.0)
    text = b"\n".join(b"line %d" % (i % 5000) for i in range(100_000))
    scores = model.document_scores([text, b"line 1", text])
    assert scores[0] == scores[2] and 0 < scores[0] < 1


def test_fit_is_bounded_by_lines(spark):
    rows = [(i, "good words here\n" * (5 + i), "s") for i in range(20)] + [(50, "x\n" * 5000, "s"), (3, "good words here\n" * 8, "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(50, 1), (50, None), (None, 1)], "doc_id long, quality int")
    model = line_crf.learn(frame(spark, rows), labels, F.lit(True), documents=30, lines=400)
    assert np.isfinite(model.weights).all() and model.weights.any()
    assert (line_crf.learn(frame(spark, rows), labels, F.lit(True), documents=30, lines=1).weights == 0).all()


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = line_crf.learn(docs, labels, line_crf.third(F.col("id")) != 1)
    scored = line_crf.score_quality(docs, model).join(labels, "doc_id").where(line_crf.third(F.col("doc_id")) == 1).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in scored) >= 0.95 * len(scored)
    odd = line_crf.score_quality(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert line_crf.score_quality(frame(spark, []), model).count() == 0
    blind = line_crf.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in line_crf.score_quality(frame(spark, ODD), blind).collect()} == {0.5}


# 10


def brute_nearest(rows, k):
    """rows: (id, vector). Counter of (query id, rank, id, score)."""
    want = Counter()
    for n, (i, q) in enumerate(rows):
        if i % 20 == 0:
            like = [(j, v) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q)]
            if like:
                scores = vector_search.exact(np.repeat([q], len(like), axis=0), np.array([v for _, v in like], dtype=float))
                best = sorted((-s, j) for (j, _), s in zip(like, scores))[:k]
                want.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    return want


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50:90] = v[40]  # equal vectors
    v[100:110] *= 1000
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(40, rows[40][1]), (40, rows[40][1]), (100, rows[7][1]), (7, rows[100][1])]  # repeated rows, and ids of several vectors
    rows += [(400 + 5 * i, [float(x) for x in rng.integers(-2, 3, 3) + 0.5]) for i in range(30)] + [(2000, [1.0, 2.0])]  # other lengths, with ties
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (None, [1.0] * 16), (1100, [])]
    vectors = spark.createDataFrame([(*r, 1.0, 2, "x", "y", "z") for r in rows + odd], "vec_id long, embedding array<float>, score double, strip int, v string, k1 string, d string")
    want = brute_nearest(rows, 7)
    for query_rows, strip_rows in ((8192, 32768), (3, 20)):
        monkeypatch.setattr(vector_search, "QUERY_ROWS", query_rows)
        monkeypatch.setattr(vector_search, "STRIP_ROWS", strip_rows)
        got = vector_search.nearest(vectors, F.col("vec_id") % 20 == 0, 7)
        assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
    assert sum(n for (i, *_), n in want.items() if i == 100) == 14
    assert vector_search.nearest(vectors.limit(0), F.lit(True)).count() == 0


def test_tiles_prune_without_loss():
    rng = np.random.default_rng(13)
    for d in (8, 2500):
        q, v = rng.normal(size=(20, d)), rng.normal(size=(500, d))
        places, at, ids, scores = vector_search.search_strip(q, v, [[1000 + j] for j in range(500)], 5, tile_rows=64)
        want = {(i, int(j)) for i in range(20) for j in np.argsort(-(q[i] @ v.T))[:5]}
        assert set(zip(places, at)) == want and all(a + 1000 == i for a, i in zip(at, ids))
    a, b = (rng.integers(-127, 128, size=(4, 3000)).astype(np.int8) for _ in range(2))
    a[0], b[0] = 127, 127
    assert (vector_search.int8_products(a, b) == a.astype(int) @ b.astype(int).T).all()


def test_nearest_over_blocks_strips_and_tiles(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 7), ("STRIP_ROWS", 60), ("TILE_QUERIES", 3)):
        monkeypatch.setattr(vector_search, name, value)
    v = np.random.default_rng(14).normal(size=(400, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in vector_search.nearest(vectors, F.col("vec_id") % 20 == 0, 5).collect()}
    scores = v.astype(float) @ v.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    assert got == {(q, k + 1): int(j) for q in range(0, 400, 20) for k, j in enumerate(np.argsort(-scores[q])[:5])}

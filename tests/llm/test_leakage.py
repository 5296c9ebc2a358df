import random

import numpy as np

from parleylake.llm import leakage as k

WORDS = "lantern harvest ferry witness quietly deciphered copper ledger stair porter weighed gilded seals midnight tribunal oarsman forged clay tablets orchard".split()
HAN = [chr(0x4E00 + 37 * i) for i in range(400)]


def english(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def chinese(rng, n):
    return "".join(rng.choice(HAN) for _ in range(n))


def test_matches_equal_brute_force():
    rng = random.Random(1)
    items = [(i, english(rng, 12) if i % 2 else chinese(rng, 40)) for i in range(6)] + [(6, "a7" + chinese(rng, 8) + "zz")]
    texts = ["", "x", chinese(rng, 5) + items[6][1][:9], chinese(rng, 30) + items[0][1][5:25] + chinese(rng, 9), english(rng, 5) + items[1][1][10:60] + "zz", items[2][1] * 2]
    q = k.Queries(items)
    codes, _ = k.fold(texts)
    got = {(int(a), int(b), int(n)) for x in k.verbatim_matches(codes, q, block=7) for a, b, n in zip(*x)}
    want = set()
    for a in range(len(q.codes)):
        for b in range(len(codes)):
            if q.codes[a] == 1 or codes[b] != q.codes[a]:
                continue
            n = 0
            while a + n < len(q.codes) and b + n < len(codes) and q.codes[a + n] == codes[b + n] != 1:
                n += 1
            need = lambda i: k.SHORT if q.codes[i] >= k.DENSE_SCRIPTS else k.LONG
            if n >= need(a) and not (a and b and q.codes[a - 1] == codes[b - 1] != 1 and n + 1 >= need(a - 1)):
                want.add((a, b, n))
    assert got == want


def test_altered_passages_and_fragments(spark):
    rng = random.Random(2)
    items = [(i, "Shared instruction: read it all. " + english(rng, 60) if i % 2 else "阅读材料并作答。" + chinese(rng, 200)) for i in range(8)]
    df_items = spark.createDataFrame([(*x, "clash") for x in items] + [(98, None, "x"), (99, "", "x")], "item_id long, text string, doc_id string")

    def altered(t):
        if " " in t[40:80]:
            w = t.upper().split(" ")
            for j in range(4, len(w), 9):
                w[j] = "other"
            return "\n> ".join(" ".join(w[j : j + 8]) for j in range(0, len(w), 8))
        return "".join(("\n[12:00:01] 阿狸: " if j % 30 == 29 else "") + ("，" if j % 17 == 16 else "") + ch for j, ch in enumerate(t))

    docs = [(i, chinese(rng, 50) + altered(items[i][1][len(items[i][1]) // 3 :]) + english(rng, 10), i) for i in range(8)]
    docs += [(20 + i, chinese(rng, 300) + items[i][1][: len(items[i][1]) // 6] + english(rng, 20), None) for i in range(8)]
    docs += [(40, None, None), (41, "", None), (42, "read it all", None), (43, english(rng, 20_000) + items[1][1] + chinese(rng, 50_000), 1), (0, docs[0][1], 0)]
    df = spark.createDataFrame([(d, t, "clash") for d, t, _ in docs], "doc_id long, text string, item_id string")
    want = sorted({(d, i) for d, _, i in docs if i is not None})
    for chars in (2_000_000, 500):
        assert sorted({(r.doc_id, r.item_id) for r in k.find_leaks(df, df_items, block_chars=chars).collect()}) == want
    assert k.without_leaks(df, k.find_leaks(df, df_items)).count() == len(docs) - len({d for d, _ in want}) - 1
    assert k.find_leaks(df.limit(0), df_items).count() == 0 and k.find_leaks(df, df_items.limit(0)).count() == 0


def test_a_dense_passage_is_not_hidden_by_stray_matches():
    a = lambda *x: np.array(x, np.int64)
    j, p, n = a(0, 54, 108), a(0, 54, 108), a(6, 6, 80)
    assert k.chained(j, p, n, k.Rules())[:2] == (134, 86) and k.chained(j[:2], p[:2], n[:2], k.Rules())[0] == 6
    rng = random.Random(5)
    for _ in range(60):
        m = rng.randrange(1, 7)
        j, p, n = (np.array([rng.randrange(hi) + lo for _ in range(m)]) for lo, hi in ((0, 160), (0, 160), (4, 30)))
        assert k.chained(j, p, n, k.Rules())[0] == brute_chain(sorted(zip(p.tolist(), j.tolist(), n.tolist())), k.Rules())


def brute_chain(m, rules):
    best = 0

    def go(b, span, held):
        nonlocal best
        if held >= rules.verbatim * span:
            best = max(best, span)
        for c in range(b + 1, len(m)):
            (pa_, ja, na), (pb, jb, nb) = m[b], m[c]
            gd, gq = pb - pa_ - na, jb - ja - na
            if -k.LONG <= gd <= rules.doc_gap and -k.LONG <= gq <= rules.item_gap and jb + nb > ja + na and pb + nb > pa_ + na:
                go(c, span + jb + nb - ja - na, held + nb + min(0, gq, gd))

    for b in range(len(m)):
        go(b, m[b][2], m[b][2])
    return best


def test_short_items(spark):
    df = spark.createDataFrame([(1, "too short"), (2, "just long enough"), (3, "太短了"), (4, "长度刚好够了"), (5, None), (6, "")], "item_id long, text string")
    assert sorted(r.item_id for r in k.short_items(df).collect()) == [1, 3, 5, 6]


def test_shards_and_folding():
    assert list(k.shards(["a" * 5, "b" * 9, "c"], 8)) == [(0, 1), (1, 2), (2, 3)] and list(k.shards([])) == []
    codes, starts = k.fold(["Ａb, C!", "é\0x"])
    assert "".join(map(chr, codes)) == "abc\x01éx\x01" and starts.tolist() == [0, 4] and isinstance(codes, np.ndarray)

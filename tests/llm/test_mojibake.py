import random

from parleylake.llm import mojibake

CLEAN = ["未命名的讨论组", "语音消息已过期", "我的手机图片", "管理员已开启全员禁言", "来自电脑的文件", "ありがとうございます", "写真を送りました", "café Grün am Fluß", "déjà vu", "Общая папка группы", "новый файл", "plain ascii name", "감사합니다 파일이", "50% off – “quoted”"]


def wrong(text, right, seen):
    return text.encode(right).decode(seen, "replace") if seen != "west" else mojibake._decode(text.encode(right), "west")


def test_every_chain_can_be_undone():
    for t in CLEAN:
        for right, seen in (("utf-8", "west"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("gbk", "west"), ("gbk", "cp1251"), ("cp1251", "west"), ("koi8-r", "cp1251"), ("euc_jp", "west"), ("cp949", "west")):
            try:
                g = wrong(t, right, seen)
            except UnicodeError:
                continue
            if g != t and "�" not in g and mojibake.HIGH.search(g):
                assert t in [x for _, x, _ in mojibake.candidates(g)], (t, right, seen)
    g = "plain ascii".encode("utf-16-le").decode("utf-16-be")
    assert "plain ascii" in [x for _, x, _ in mojibake.candidates(g)]


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    chains = [("utf-8", "west"), ("utf-8", "gbk"), ("gbk", "west"), ("utf-8", "mac_roman"), ("cp1251", "west"), ("gbk", "cp1251")]
    rows, bad = [], {}
    for i in range(3000):
        t = f"{rng.choice(CLEAN)} {rng.randrange(99)}" if rng.random() < 0.7 else rng.choice(CLEAN) + rng.choice(CLEAN)
        if i % 12 == 0:
            right, seen = rng.choice(chains)
            try:
                g = wrong(t, right, seen)
            except UnicodeError:
                g = t
            if g != t:
                bad[i] = t
            t = g
        rows.append((i, 0, f"f{i % 3}", t))
    df = spark.createDataFrame(rows, "k long, p int, field string, text string")
    got = {r.k: r.restored for r in mojibake.repair_garbled(df, keys=["k"]).collect()}
    assert len(set(got) & set(bad)) >= 0.97 * len(bad) and len(set(got) - set(bad)) <= 0.01 * len(rows)
    whole = [k for k in bad if "�" not in dict((r[0], r[3]) for r in rows)[k]]
    assert sum(got.get(k) == bad[k] for k in whole) >= 0.9 * len(whole)


def test_nulls_empty_long_and_repeated(spark):
    rows = [(1, None, None), (2, "f", ""), (3, None, "ï¿½a�"), (3, None, "ï¿½a�"), (4, "f", "好" * 30_000), (5, "f", "Ã©" * 3000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "k long, field string, text string, chain string, n string")
    got = mojibake.repair_garbled(df, keys=["k"])
    assert sorted({r.k for r in got.collect()} - {4}) == [3, 5] and got.where("k = 3").count() == 2
    assert mojibake.repair_garbled(df.limit(0), keys=["k"]).count() == 0


def test_genuine_words_beside_garbled_ones_stay(spark):
    texts = [f"{a} {b} {n}" for a in ("Привет", "Общая папка", "новый файл") for b in ("Straße", "Grün am Fluß", "déjà vu") for n in range(40)]
    mixed = {"Straße Ïðèâåò": "Straße Привет", "Ïðèâåò Straße": "Привет Straße", "Grün Ïðèâåò Straße": "Grün Привет Straße"}
    garbled = [wrong("Привет " + str(n), "cp1251", "west") for n in range(30)]
    df = spark.createDataFrame([(i, "f", t) for i, t in enumerate([*texts, *garbled, *mixed])], "k long, field string, text string")
    got = {r.text: r.restored for r in mojibake.repair_garbled(df, keys=["k"]).collect()}
    assert {t: got.get(t) for t in mixed} == mixed and not set(texts) & set(got)

import random
import re
import unicodedata

import numpy as np
import pytest

from ledgerlens.llm import leak, mixing, near_dup, reading, segments, site_lines, term_counts
from tests.conftest import rows

# Splitting ---------------------------------------------------------------------------------------------


def check_pieces(text, most=1100, overlap=(80, 150)):
    pieces = segments.split_text(text, most, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= most for a, b in pieces)
    assert all(overlap[0] <= end - start <= overlap[1] for (_, end), (start, _) in zip(pieces, pieces[1:], strict=False))
    return pieces


@pytest.mark.parametrize("text", ["字" * 5000, "一句话很短。" * 900, ("长句，" * 300 + "\n") * 4, "| a | 1 |\n" * 700, "word " * 900, "𠀀" * 2300, "甲" * 1101])
def test_pieces_hold_the_whole_text(text):
    pieces = check_pieces(text)
    for a, b in pieces[:-1]:
        if "。" in text:
            assert text[b - 1] == "。"
        if text.startswith("|"):
            assert text[b - 1] == "\n"


def test_pieces_of_random_texts():
    rng = random.Random(4)
    for _ in range(30):
        check_pieces("".join(rng.choice("酒水粮收入，。；\n a1") for _ in range(rng.randint(1101, 6000))))


def test_cut_at_the_change_of_topic():
    wine, bank = "窖池发酵出酒率提高。", "银行贷款利息支出减少。"
    text = wine * 70 + bank * 70
    (_, end), *_ = segments.split_text(text, 1100)
    assert end == len(wine * 70)


def test_depth_climbs_to_the_nearest_peak_only():
    similarity = np.array([0.9, 0.2, 0.8, 0.5, 0.3, 0.5, 0.4, 0.1, 0.7, 0.6])
    assert segments.depths(similarity)[2:7] == pytest.approx([0.0, 0.3, 0.7, 0.0, 0.1])
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(0, 6, rng.integers(1, 30)).astype(float)
        for k, depth in enumerate(segments.depths(s)):
            a = b = k
            while a > 0 and s[a - 1] >= s[a]:
                a -= 1
            while b < len(s) - 1 and s[b + 1] >= s[b]:
                b += 1
            assert depth == s[a] + s[b] - 2 * s[k]


def test_the_last_piece_is_no_crumb():
    for n in (1101, 1150, 1300, 1700, 2060, 2100, 3111):
        pieces = check_pieces("酒" * n)
        assert pieces[-1][1] - pieces[-2][1] >= 345


def test_split_table(spark):
    long = "句子。" * 500
    df = spark.createDataFrame([(1, long, 3, "x"), (1, long, 3, "x"), (2, "短", 1, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (None, long, 1, "x"), (5, "a" * 40_000, None, "x")], "idx bigint, text string, page_start int, piece string")
    out = segments.split_oversized(df, "idx", "text", ["page_start"])
    found = rows(out.select("idx", "piece", "page_start"))
    assert {f[0] for f in found} == {1, 5} and sum(f[0] == 1 for f in found) == 2 and {f[2] for f in found if f[0] == 5} == {None}
    assert rows(segments.split_oversized(df.where("false"), "idx", "text", ["page_start"])) == []
    with pytest.raises(ValueError):
        segments.split_text("x" * 300, 200, (150, 190))


# Near duplicates ---------------------------------------------------------------------------------------


def variants(seed, families=25, copies=6):
    rng = random.Random(seed)
    words = [f"{rng.choice('甲乙丙丁戊己庚辛')}{rng.choice('子丑寅卯辰巳午未')}{rng.choice('天地玄黄宇宙洪荒')}" for _ in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(1, copies)):
            own = base[:]
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(60)] = rng.choice(words)
            out.append("".join(own))
    return [(i, t, "x") for i, t in enumerate(out)]


def plain_pairs(data, threshold, width, unit):
    sets = {i: near_dup.shingle_set(t, width, unit) for i, t, _ in data if t}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize(("limit", "hot_rows", "block"), [(400, 100_000, 4096), (3, 100_000, 4), (3, 20, 4)])
def test_near_duplicates_against_all_pairs(spark, limit, hot_rows, block):
    data = variants(5)
    df = spark.createDataFrame(data, "idx bigint, text string, rep string")
    got = {tuple(r) for r in near_dup.NearDuplicates(df, "idx", "text", 0.7, 5, "char", limit=limit, hot_rows=hot_rows, block=block).pairs().collect()}
    expected = plain_pairs(data, 0.7, 5, "char")
    assert got <= expected and len(got) >= 0.99 * len(expected) and len(expected) > 30


def test_copies_and_groups(spark):
    base = "".join(chr(0x4E00 + i) for i in range(200))
    data = [(1, base), (2, base), (2, base), (3, base[:-3] + "abc"), (4, "别的"), (5, None), (6, ""), (7, " \n"), (None, base), (8, base[:2] + " " + base[2:]), (9, "短"), (10, "短")]
    near = near_dup.NearDuplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text", 0.8, 5, "char")
    assert rows(near.pairs()) == [(1, 2), (1, 3), (1, 8), (2, 3), (2, 8), (3, 8), (9, 10)] or rows(near.pairs()) == sorted([(1, 2), (1, 3), (1, 8), (2, 3), (2, 8), (3, 8), (9, 10)], key=repr)
    assert {r["id"]: (r["rep"], r["group"], r["links"]) for r in near.groups().collect()} == {1: (1, 1, 1), 2: (1, 1, 1), 8: (1, 1, 1), 3: (3, 1, 1), 4: (4, 4, 0), 9: (9, 9, 0), 10: (9, 9, 0)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.9])
def test_recall_of_the_plan(threshold):
    """Pairs at the threshold that meet in some node at any depth and pass the sketch, over many pairs of sets."""
    rng, how = np.random.default_rng(int(threshold * 10)), near_dup.plan(threshold)
    pairs, shared = 3000, round(1000 * threshold)
    rest = (1000 - shared) // 2
    both = rng.integers(0, 2**63, (pairs, 2 * rest + shared), dtype=np.uint64)
    a, b = ([near_dup.minwise(x) for x in side] for side in (both[:, : rest + shared], both[:, rest:]))
    bits = lambda m: (np.array(m) >> np.uint32(9)) & np.uint32(1)
    close = (bits(a) != bits(b)).sum(axis=1) <= how.apart
    left, right = (np.array([x[: near_dup.TOKENS] for x in side]) for side in (a, b))
    nodes = np.tile(near_dup._mix(np.arange(1, how.trees + 1, dtype=np.uint64)), (pairs, 1))
    met = np.ones((pairs, how.trees), dtype=bool)
    for _ in range(6):
        one, two = near_dup._branch(nodes, left, how.branch), near_dup._branch(nodes, right, how.branch)
        met = np.tile(met, (1, how.branch)) & (one == two)
        assert (met.any(axis=1) & close).mean() >= 0.98
        if met.shape[1] > 4000:
            break
        nodes = one


def test_every_text_of_a_record_is_linked(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(60))
    one, two = [word() for _ in range(20)], [word() for _ in range(20)]
    data = [(i, t) for i in range(20) for t in (one[i], two[i])] + [(100 + i, one[i] + "尾") for i in range(20)] + [(200 + i, two[i] + "尾") for i in range(20)]
    near = near_dup.NearDuplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text", 0.8, 5, "char")
    assert rows(near.pairs()) == sorted([(i, k + i) for i in range(20) for k in (100, 200)], key=repr)
    got = {r["id"]: (r["rep"], r["group"], r["links"]) for r in near.groups().collect()}
    assert got == {k + i: (k + i, i, 1 if k else 2) for i in range(20) for k in (0, 100, 200)}


def test_a_third_of_all_rows_is_split_over_tasks(spark):
    """A third of the rows are copies of one text, another third nearly equal: no node, class or hub meets in one task, nothing is lost."""
    words = [f"w{i}" for i in range(200)]
    data = [(i, " ".join(words)) for i in range(100)] + [(1000 + i, " ".join([*words, f"own{i}"])) for i in range(100)] + [(2000 + i, f"other {i} " * 9 + str(i * i)) for i in range(100)]
    near = near_dup.NearDuplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text", limit=10, hot_rows=30, block=20)
    groups = {r["id"]: (r["group"], r["links"]) for r in near.groups().collect()}
    assert {groups[i] for i in range(100)} == {(0, 100)} and {groups[1000 + i] for i in range(100)} == {(0, 100)}
    assert near.pairs().where("id_b < 2000").count() == 200 * 199 // 2


def test_a_large_cluster_of_near_copies_stays_whole(spark):
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join([*words, f"own{i}"])) for i in range(90)] + [(1000 + i, f"other {i} " * 30) for i in range(30)]
    near = near_dup.NearDuplicates(spark.createDataFrame(data, "id bigint, text string"), "id", "text", limit=10)
    groups = {r["id"]: r["group"] for r in near.groups().collect()}
    assert {groups[i] for i in range(90)} == {0} and near.pairs().where("id_b < 90").count() == 90 * 89 // 2


def test_no_rows_no_pairs(spark):
    empty = near_dup.NearDuplicates(spark.createDataFrame([], "id bigint, text string"), "id", "text")
    assert rows(empty.pairs()) == [] and rows(empty.groups()) == []
    with pytest.raises(ValueError):
        near_dup.NearDuplicates(spark.range(1), "id", "id", unit="line")
    with pytest.raises(ValueError):
        near_dup.NearDuplicates(spark.range(1), "id", "id", threshold=0.1)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (5, 5)], "a bigint, b bigint")
    got = dict(rows(near_dup.components(links)))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


# Repeated lines ----------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    pages = [("k", p, f"第 {p} 页　共９页\n独有{'甲乙丙丁戊己庚'[p]}\n| 表 |\n[注]\n\n" + ("公告" if p < 3 else "")) for p in range(6)]
    pages += [("k", 0, "另一版\n公告\t"), ("k", 6, None), ("k", 0, pages[0][2]), ("small", 1, "同\n同"), ("small", 2, "同"), (None, 1, "同"), ("k", None, "同")]
    df = spark.createDataFrame([(*r, "x") for r in pages], "key string, page int, text string, line string")
    assert rows(site_lines.repeated_lines(df, "key", "page", "text")) == [("k", "公告", 3, 7), ("k", "第 # 页 共#页", 6, 7)]
    clean = {(r["source"], r["doc"], r["text"], r["removed"]) for r in site_lines.without_repeated_lines(df, "key", "page", "text").collect()}
    assert ("k", 1, "独有乙\n| 表 |\n[注]\n", 2) in clean and ("k", 0, "另一版", 1) in clean and ("k", 6, None, 0) in clean and ("small", 2, "同", 0) in clean
    assert (None, 1, "同", 0) in clean and len(clean) == 12
    assert rows(site_lines.repeated_lines(df.where("false"), "key", "page", "text")) == []


def test_bitmaps_span_many_words(spark):
    df = spark.createDataFrame([("k", p, "同一行" if p % 2 else "a") for p in range(-3, 400)], "key string, page int, text string")
    assert {r[1]: r[2] for r in rows(site_lines.repeated_lines(df, "key", "page", "text"))} == {"a": 201, "同一行": 202}


@pytest.mark.parametrize(("hot_rows", "lookup_rows"), [(100_000, 20_000), (7, 0)])
def test_lines_of_documents_with_any_id(spark, hot_rows, lookup_rows):
    """Addresses as ids, one source with most documents, against a plain count."""
    rng = random.Random(11)
    data = [(source, f"https://{source}/{d}", "\n".join(rng.sample([f"line {chr(97 + k)}" for k in range(26)], 6) + ["foot"] * (d % 3 > 0))) for source, n in (("big", 90), ("mid", 12), ("tiny", 4)) for d in range(n)]
    df = spark.createDataFrame(data, "site string, url string, body string")
    held = {}
    for source, url, body in data:
        for line in set(body.split("\n")):
            held.setdefault((source, line), set()).add(url)
    size = {"big": 90, "mid": 12}
    expected = {(s, x, len(d), size[s]) for (s, x), d in held.items() if s in size and len(d) > 0.3 * size[s]}
    assert {tuple(r) for r in site_lines.repeated_lines(df, "site", "url", "body", hot_rows=hot_rows).collect()} == expected
    gone = {(s, x) for s, x, *_ in expected}
    clean = {r["doc"]: (r["text"], r["removed"]) for r in site_lines.without_repeated_lines(df, "site", "url", "body", hot_rows=hot_rows, lookup_rows=lookup_rows).collect()}
    for source, url, body in data:
        kept = [x for x in body.split("\n") if (source, x) not in gone]
        assert clean[url] == ("\n".join(kept), len(body.split("\n")) - len(kept))


# Term counts -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3, 5000, 65536])
def test_containers_round_trip(n):
    rng = np.random.default_rng(n)
    places = np.sort(rng.choice(65536, n, replace=False))
    counts = rng.choice([1, 1, 1, 2, 70_000], n)
    back = term_counts.unpack(term_counts.pack(places, counts))
    assert (back[0] == places).all() and (back[1] == counts).all()
    half = [term_counts.pack(places[::2], counts[::2]), term_counts.pack(places, np.ones(n, dtype=int))]
    merged = term_counts.union(half)
    assert (merged[0] == places).all() and (merged[1][::2] == counts[::2]).all()


def test_term_counts(spark):
    data = [(1, "酒厂酒厂 ＡＢ ab c", "第 一　节"), (1, "酒厂酒厂 ＡＢ ab c", "第 一　节"), (70_000, "酒厂", "第一节"), (-5, None, ""), (3, "", None), (None, "酒厂", "x"), (4, "酒" * 100_000, "第一节")]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "idx bigint, text string, section string, term string, records int").repartition(3)
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in term_counts.term_counts(df, "idx", "text", "section").collect()}
    assert got == {("text", "酒厂"): (3, 2, None), ("text", "厂酒"): (1, 1, "rare"), ("text", "ab"): (2, 1, "rare"), ("text", "酒酒"): (99_999, 1, "rare"), ("section", "第一节"): (3, 3, "common")}
    assert rows(term_counts.term_counts(df.where("false"), "idx", "text", "section")) == []


def test_versions_of_a_record_count_by_the_higher_count(spark):
    df = spark.createDataFrame([(1, "酒厂"), (1, "酒厂酒厂"), (1, "酒厂")], "idx bigint, text string").coalesce(1)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts.term_counts(df, "idx", "text").collect()}
    assert got["酒厂"] == (2, 1)


# Leaks -------------------------------------------------------------------------------------------------


def plain_leaks(docs, items, least):
    found = set()
    grams = {}
    for i, t in items:
        t = leak.normal(t or "")
        for k in range(len(t) - least + 1):
            grams.setdefault(t[k : k + least], set()).add(i)
    for d, t in docs:
        t = leak.normal(t or "")
        for k in range(len(t) - least + 1):
            found |= {(d, i) for i in grams.get(t[k : k + least], ())}
    return found


@pytest.mark.parametrize("least", [1, 5, 12, 40])
def test_leaks_against_all_windows(least):
    rng = random.Random(least)
    items = [(i, "".join(rng.choice("甲乙丙丁，") for _ in range(rng.randint(0, 120)))) for i in range(12)]
    docs = []
    for d in range(60):
        own = "".join(rng.choice("甲乙丙丁戊 。") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            _, t = rng.choice(items)
            a = rng.randint(0, max(0, len(t) - 1))
            own += t[a : a + rng.randint(0, 90)]
        docs.append((d, own))
    finder = leak.LeakFinder(items, least)
    assert {(d, i) for d, t in docs for _, _, ids in finder.spans(leak.normal(t)) for i in ids} == plain_leaks(docs, items, least)


def test_items_beyond_one_automaton(spark):
    """Many automata, hot ones spread over tasks, find and cut what one automaton does."""
    rng = random.Random(12)
    items = [(i, "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(20, 60)))) for i in range(60)] + [(99, None), (98, "甲乙")]
    docs = [(d, "".join(t[:-3] if rng.random() < 0.5 else t for _, t in rng.sample(items[:60], 2)) + "外文本" * 30) for d in range(40)] + [(7, "外" * 50), (None, "x"), (50, None)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, expected string"), "doc_id", "text", "item_id", "expected", 12
    assert rows(leak.leaks(*args, chars=150, hot_rows=5)) == rows(leak.leaks(*args))
    assert {(r["doc_id"], r["item_id"]) for r in leak.leaks(*args, chars=150).collect()} == plain_leaks([d for d in docs if d[0] is not None], items, 12)
    assert rows(leak.scrub(*args, chars=150, hot_rows=5)) == rows(leak.scrub(*args)) != []
    assert rows(leak.leaks(args[0].where("false"), *args[1:], chars=150)) == []


def test_fifty_thousand_items(spark):
    """Items far beyond one automaton: nothing of their number reaches the driver, each leaked one is found."""
    item = lambda i: "".join(chr(0x4E00 + (i * 7919 + k * k * 31 + k * i) % 20000) for k in range(50))
    items = spark.createDataFrame([(i, item(i)) for i in range(50_000)], "item_id bigint, expected string")
    docs = spark.createDataFrame([(d, "前" * 9 + item(d * 50)[3:48] + "后" * 60) for d in range(1000)], "doc_id bigint, text string")
    found = leak.leaks(docs, items, "doc_id", "text", "item_id", "expected")
    got = {(r["doc_id"], r["item_id"]): r["chars"] for r in found.collect()}
    assert {(d, d * 50) for d in range(1000)} <= set(got) and min(got.values()) >= 40


def test_only_the_span_goes_from_texts_of_joining_characters():
    leaked = "".join(chr(0xAC00 + 588 * (i % 19) + 28 * (i % 21) + i % 28) for i in range(45))
    finder = leak.LeakFinder([(1, leaked)], 40)
    before, after = "앞글 " * 30, " 뒷글" * 30
    apart = lambda x: unicodedata.normalize("NFD", x)
    cut = lambda t, f: leak.cut_spans(t, [(a, b) for a, b, _ in f.spans(leak.normal(t))], 0.5)
    one = "산" + "문" * 60 + "\n\n" + "글" * 1300
    assert cut(apart("각") + one, leak.LeakFinder([(1, "문" * 49)], 40))[1] == 60
    assert cut(apart(before + leaked + after), finder) == (apart(before + after), len(apart(leaked)), False)
    rng = random.Random(5)
    odd = [*"aeΣσ1 .가각ㄱㅏ卡ﬁ①㍿ｶﾊカはÅİ", *apart("각힣"), *"\u0301\u0323\u3099ﾞﾟ\u0f71\u0f72\u0344\u1161\u11a8\u0338\u09be\u09c7\u1ffe"]
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(1, 12)))
        pieces = list(leak.segments(text))
        assert "".join(text[a:b] for a, b in pieces) == text
        assert "".join(unicodedata.normalize("NFKC", text[a:b]) for a, b in pieces) == unicodedata.normalize("NFKC", text)
        assert sum(len(leak.normal(text[a:b])) for a, b in pieces) == len(leak.normal(text))
        assert len(leak.owners(text + "\n" + text)) == 2 * len(leak.normal(text))


def test_leak_table_and_scrub(spark):
    passage = "据溆峡葭核对，萱棠汀库区账面多出125箱，差异率43%，已转璞潭松科处理。该批次的交付比计划晚72天。"
    docs = [(1, "开头。" + passage.replace("1", "１") + "结尾，" + "无关的文字" * 30), (1, "开头。" + passage.replace("1", "１") + "结尾，" + "无关的文字" * 30), (2, passage[:30]), (3, None), (4, ""), (None, passage), (5, passage), (6, "长" * 300_000 + passage)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, passage, "q"), (8, None, "q"), (9, "短", passage), (7, passage, "q")], "item_id bigint, expected string, question string")
    args = (df, items, "doc_id", "text", "item_id", "expected")
    assert rows(leak.leaks(*args).select("doc_id", "item_id")) == [(1, 7), (5, 7), (6, 7)]
    assert rows(leak.leak_report(*args)) == [(7, 3, len(leak.normal(passage)))]
    cut = {r["doc_id"]: (r["text"], r["dropped"]) for r in leak.scrub(*args).collect()}
    assert cut[1] == ("开头。。结尾，" + "无关的文字" * 30, False) and cut[5] == (None, True) and cut[6][0].rstrip("。") == "长" * 300_000
    assert rows(leak.leaks(df.where("false"), *args[1:])) == [] and rows(leak.leaks(df, items.where("false"), *args[2:])) == []


# Mixing ------------------------------------------------------------------------------------------------


def test_mixture_reaches_its_shares(spark, tmp_path):
    import base64

    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    rng = random.Random(6)
    docs = [(i, "字" * rng.randint(20, 200), ("big", " BIG", "small", "none", None)[min(4, int(rng.random() ** 2 * 5))], rng.choice(["zh", "zh-CN", "en", None]), rng.choice(["甲2020年问答", "2021年纪要", None])) for i in range(1500)]
    docs += docs[:100] + [(None, "x", "big", "zh", "t"), (9000, None, "small", "zh", "t"), (9001, "", "big", "zh", "t")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, lang string, title string, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), ("big", 0.5, 1), (None, 0.3, 1)], "source string, target_share double, max_repeat int")
    mixture = mixing.mix(df, targets, "doc_id", "text", "source", "lang", "title", tokenizer=str(ranks))
    told = mixing.shares(mixture).collect()
    got = {r["value"]: r for r in told if r["margin"] == "source"}
    assert got["absent"]["tokens"] == 0 and set(got) == {"big", "small", "absent"}
    langs = {r["value"]: r for r in told if r["margin"] == "language"}
    assert set(langs) == {"zh", "en", "und"} and all(abs(r["residual"]) < 0.05 and r["steady"] for r in langs.values())
    assert sum(r["reached_share"] for r in langs.values()) == pytest.approx(1, abs=1e-4)
    few = mixing.mix(df, targets, "doc_id", "text", "source", "lang", "title", tokenizer=str(ranks), values=1, total=20_000.0, goals={"lang": {"zh": 0.9, "other": 0.1}})
    share = {(r["margin"], r["value"]): r["reached_share"] for r in mixing.shares(few).collect()}
    assert few.folded == {"lang": 2, "topic": 2} and share["language", "zh"] == pytest.approx(0.9, abs=0.04)
    assert not mixing.mix(df, targets, "doc_id", "text", "source", "lang", "title", tokenizer=str(ranks), rounds=1).raking.steady
    assert got["big"]["reached_share"] == pytest.approx(0.5 / 0.9, abs=0.02) and got["small"]["reached_share"] == pytest.approx(0.4 / 0.9, abs=0.02)
    assert got["big"]["most_copies"] == 1 and got["small"]["most_copies"] <= 3
    used = mixing.documents(mixture)
    assert used.count() == used.select("doc_id").distinct().count() and used.where("doc_id >= 9000").count() == 0
    assert used.agg({"tokens": "min"}).first()[0] >= 60
    again = mixing.mix(df.repartition(7), targets, "doc_id", "text", "source", "lang", "title", tokenizer=str(ranks))
    assert rows(mixing.documents(again)) == rows(used)
    nothing = mixing.mix(df.where("false"), targets, "doc_id", "text", "source", "lang", "title", tokenizer=str(ranks))
    assert rows(mixing.documents(nothing)) == [] and {(r["value"], r["tokens"]) for r in mixing.shares(nothing).collect()} == {("big", 0), ("small", 0), ("absent", 0)}


def test_raking_keeps_caps():
    import pandas as pd

    cells = pd.DataFrame({"source": ["a", "a", "b"], "lang": ["x", "y", "x"], "topic": ["t", "t", "t"], "tokens": [100, 100, 50]})
    targets = pd.DataFrame({"source": ["a", "b"], "target_share": [0.5, 0.5], "max_repeat": [1, 2]})
    weight = mixing.rake(cells, targets, 400.0).weight
    assert (weight <= [1, 1, 2]).all() and weight[:2] @ [100, 100] == pytest.approx(200) and weight[2] * 50 == pytest.approx(100)
    easy = mixing.rake(cells, targets, 120.0).weight
    assert easy[:2] @ [100, 100] == pytest.approx(60) and easy[2] * 50 == pytest.approx(60)


# Reading levels ----------------------------------------------------------------------------------------

EASY = ["天冷了。", "我们去看酒。", "水很好喝。", "大家都说好。", "The boy has a cup."]
HARD = ["依照关键审计事项的识别程序，资本化研发支出的后续计量受制于不可观察输入值的选取。", "鉴于递延所得税资产可抵扣暂时性差异的转回期间，合并主体须予以重新计量。", "Pursuant to the impairment methodology, unobservable inputs were stratified."]
PLAIN = ["公司在老城区增加了网点，销售部门改进了排产方案。", "本年度费用率略有抬升，订单更加集中。", "The sales office renewed the plan after a trial."]
MIX = {1: (0.9, 0.1, 0.0), 2: (0.4, 0.6, 0.0), 3: (0.05, 0.9, 0.05), 4: (0.0, 0.6, 0.4), 5: (0.0, 0.2, 0.8)}


def document(rng, level):
    kinds = rng.choices([EASY, PLAIN, HARD], MIX[level], k=14)
    return "".join(rng.choice(k) for k in kinds)


def test_levels_on_held_out_documents(spark):
    rng = random.Random(7)
    levels = [rng.randint(1, 5) for _ in range(400)]
    texts = [document(rng, k) for k in levels]
    noisy = [[min(5, max(1, k + rng.choice([0, 0, 0, 1, -1]))) for _ in range(rng.randint(1, 2))] for k in levels[:250]]
    model = reading.fit(texts[:250], noisy)
    data = [(i, t, 0) for i, t in enumerate(texts[250:])]
    edge = [(900, None, 0), (901, "", 0), (902, "。！ \n", 0), (None, "天冷了。", 0), (0, data[0][1], 0), (903, HARD[0] * 3000, 0)]
    df = spark.createDataFrame(data + edge, "doc_id bigint, text string, level int")
    got = {r["doc_id"]: r for r in reading.reading_levels(df, model, "doc_id", "text").collect()}
    true = levels[250:]
    assert sum(abs(got[i]["level"] - k) <= 1 for i, k in enumerate(true)) >= 0.97 * len(true)
    for band in (1, 5):
        found, real = {i for i in range(150) if got[i]["level"] == band}, {i for i, k in enumerate(true) if k == band}
        assert len(found & real) >= 0.8 * max(len(found), len(real))
    assert got[900]["level"] is None and got[901]["n_chars"] == 0 and got[902]["difficulty"] is None and None not in got and got[903]["level"] == 5
    assert rows(reading.reading_levels(df.where("false"), model, "doc_id", "text")) == []


def test_fit_on_little_or_nothing():
    assert reading.fit([], []).difficulty([["甲"]])[0] == pytest.approx(3.0)
    assert reading.fit(["天冷了。", "", "x"], [[1], [2], []]).difficulty([["天冷了。"], []])[0] == pytest.approx(1.0, abs=0.5)


def test_labelled_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(i, f"文{i}") for i in range(50)] + [(1, "文1"), (60, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "r", 2) for i in range(50)] + [(1, "r", 2), (2, "s", None), (3, "s", 9), (60, "r", 1), (None, "r", 1)], "doc_id bigint, rater string, reading_level int")
    texts, levels = reading.labelled_sample(docs, labels, "doc_id", "text", "reading_level", "rater")
    assert len(texts) == 50 and all(x == [2] for x in levels)
    assert len(reading.labelled_sample(docs, labels, "doc_id", "text", "reading_level", "rater", 7)[0]) <= 7


def test_sentences():
    assert reading.sentences("甲。乙！\n\n丙；3.5 is it. Yes") == ["甲。", "乙！", "丙；", "3.5 is it.", "Yes"]
    assert reading.sentences("。。 \n") == [] and re.sub(r"\s", "", "".join(reading.sentences("a b. c。d"))) == "ab.c。d"

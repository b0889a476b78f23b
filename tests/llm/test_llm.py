import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, stuffing, tokens, topn
from palimpsest.operators import firsts
from palimpsest.shared import write_shared

pytest.importorskip("tokenizers")
DOCS = "doc_id bigint, text string, lang string, block int, n_tokens string"
ODD = ["", None, " ", "\n\n \t", "it's the dogs' day", "naïve café", "日本語のテキスト。", "مرحبا بالعالم", "😀😀 🇩🇪", "a\x00b\x1f", "​﻿", "<|endoftext|> x", "x" * 5000, " " * 3000 + "y", "१२३ ４５６", "՘꟎\U00010940", "é́", "don't DON'T 'S", "　a b c"]


@pytest.fixture(scope="module")
def whole():
    loaded = tokens._tokenizer(tokens.BYTE_BPE)
    return lambda text: loaded.encode(text, add_special_tokens=False).ids if text else []


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "clash") for i, t in enumerate(texts)], DOCS)


def test_encode_equals_the_tokenizer(spark, whole, monkeypatch):
    r = random.Random(1)
    words = ["the", "River", "café", "мост", "12", "!!", "\n", "  ", "橋", "’s", "'ll"]
    texts = ODD + ["".join(r.choice([" ", ""]) + r.choice(words) for _ in range(r.randrange(400))) for _ in range(60)]
    got = {x.doc_id: x.ids for x in tokens.encode_corpus(docs(spark, texts)).collect()}
    assert got == {i: whole(t) for i, t in enumerate(texts)}


def test_common_words_are_joined_apart(spark, whole, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(tokens, "LEAST_COMMON", 3)
    texts = [f"the river {i} the mill" for i in range(40)]
    got = {x.doc_id: x.ids for x in tokens.encode_corpus(docs(spark, texts)).collect()}
    assert got == {i: whole(t) for i, t in enumerate(texts)}


def test_copies_across_tasks(spark, whole):
    texts = ["one two three " * 40] * 30
    got = tokens.encode_corpus(docs(spark, texts).repartition(3)).collect()
    assert len(got) == 30 and all(x.ids == whole(texts[0]) for x in got)


def test_repeated_and_null_ids(spark, whole):
    rows = spark.createDataFrame([(1, "a b", "", 0, ""), (1, "c", "", 0, ""), (None, "d", "", 0, "")], DOCS)
    assert sorted((str(x.doc_id), x.ids) for x in tokens.encode_corpus(rows).collect()) == sorted([("1", whole("a b")), ("1", whole("c")), ("None", whole("d"))])
    assert tokens.encode_corpus(rows.limit(0)).count() == 0


def test_round_trip(spark):
    back = {x.doc_id: x.text for x in tokens.decode_corpus(tokens.encode_corpus(docs(spark, ODD))).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    rows = spark.createDataFrame([(1, None), (2, [-5, 10**6]), (None, [32])], "doc_id bigint, ids array<int>")
    assert sorted((str(x.doc_id), x.text) for x in tokens.decode_corpus(rows).collect()) == [("1", ""), ("2", ""), ("None", "A")]


def test_sizes(spark, whole):
    got = {x.doc_id: x.n_tokens for x in tokens.token_sizes(docs(spark, ODD).drop("n_tokens")).collect()}
    assert got == {i: len(whole(t)) for i, t in enumerate(ODD)}


def test_settled_characters_are_cut_alike():
    cut, own = tokens._cutter(tokens.BYTE_BPE), tokens._tokenizer(tokens.BYTE_BPE).pre_tokenizer.pre_tokenize_str
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)}! {chr(c)} "
            if c < 0x30000 or c % 97 == 0:
                assert cut(text) == [text[a:b] for _, (a, b) in own(text)], hex(c)


@pytest.mark.parametrize("seed, n", [(0, 3), (1, 1), (2, 50), (1, 5000)])
def test_top_per_group(spark, monkeypatch, seed, n):
    r = random.Random(seed)
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", [500_000, 0, 500_000][seed])
    monkeypatch.setattr(firsts, "RANK_ROWS", [200_000, 100, 70][seed])
    rows = [(r.choice([1, 1, 1, 2, 3, None, r.randrange(40)]), r.choice([None, *range(300)]), r.choice([1, 1, 1, 2, None, r.randrange(100)]), "x") for _ in range(4000)]
    got = topn.top_per_group(spark.createDataFrame(rows, "g bigint, i bigint, s int, _rank string"), "g", "i", "s", n).collect()
    best = {}
    for g, i, s, _ in rows:
        if None not in (g, i, s):
            best[g, i] = max(s, best.get((g, i), s))
    want = {(g, i, s) for h in {g for g, _ in best} for s, i, g in [(-s, i, g) for s, i, g in sorted((-s, i, g) for (g, i), s in best.items() if g == h)[:n]]}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_bands_read_their_own_folders(spark, monkeypatch):
    read = []
    monkeypatch.setattr(topn, "write_shared", lambda df, name, by=None: read.append((name, df)) or write_shared(df, name, by))
    df = spark.range(4000).selectExpr("id % 5 AS g", "id AS i", "id AS s")
    assert topn.top_per_group(df, "g", "i", "s", 2).count() == 10
    first = next(df for name, df in read if name == "topn-band")
    assert "PartitionFilters: [isnotnull(_band" in first._jdf.queryExecution().toString() and sum(name == "topn-band" for name, _ in read) == 1


def test_top_of_equal_scores_and_nothing(spark):
    df = spark.createDataFrame([(date(2026, 1, 1), i, 1) for i in range(500)] * 2, "g date, i bigint, s int")
    assert sorted(x.i for x in topn.top_per_group(df, "g", "i", "s", 20).collect()) == list(range(20))
    assert topn.top_per_group(df.limit(0), "g", "i", "s", 20).count() == 0


def cheapest(patterns, targets, total):
    """Sent and cost of a flow found token by token, by Bellman-Ford on the whole graph with an arc for each use of a pattern."""
    arcs = []  # from, to, room, cost; an arc and its reverse lie together
    for p, n in patterns.items():
        for r in range(1, min(targets[s][1] for s in p) + 1):
            arcs += [["in", p, n, 2 * r - 1], [p, "in", 0, 1 - 2 * r]]
        for s in p:
            arcs += [[p, s, 10**6, 0], [s, p, 0, 0]]
    for s, (share, _) in targets.items():
        arcs += [[s, "out", int(share * total), 0], ["out", s, 0, 0]]
    sent = cost = 0
    while True:
        best, via = {"in": 0}, {}
        changed = True
        while changed:
            changed = False
            for i, (a, b, room, price) in enumerate(arcs):
                if room and a in best and best[a] + price < best.get(b, 10**9):
                    best[b], via[b], changed = best[a] + price, i, True
        if "out" not in best:
            return sent, cost
        at = "out"
        while at != "in":
            arcs[via[at]][2] -= 1
            arcs[via[at] ^ 1][2] += 1
            at = arcs[via[at]][0]
        sent, cost = sent + 1, cost + best["out"]


@pytest.mark.parametrize("seed", range(12))
def test_route_is_a_cheapest_flow(seed):
    r = random.Random(seed)
    targets = {s: (w / 10, r.randrange(1, 4)) for s, w in zip("abcd", [4, 3, 2, 1])}
    sets = [("a",), ("b",), ("c",), ("d",), ("a", "b"), ("b", "c"), ("a", "c", "d"), ("a", "b", "c", "d"), ("b", "d")]
    patterns = {p: r.randrange(1, 12) for p in r.sample(sets, r.randrange(2, 7))}
    for total in (5, 20, 60):
        reached, flows = mixing.route(patterns, targets, total)
        cost = 0
        for p, n in patterns.items():
            used = sum(flows[p, s] for s in p)
            assert used <= n * min(targets[s][1] for s in p)
            whole, rest = divmod(used, n)
            cost += n * whole * whole + rest * (2 * whole + 1)
        assert all(sum(n for (_, s), n in flows.items() if s == t) <= int(w * total) for t, (w, _) in targets.items())
        assert (reached, cost) == cheapest(patterns, targets, total)
    most = mixing.largest_total(patterns, targets)
    live = {s for p in patterns for s in p}
    full = lambda t: sum(int(targets[s][0] * t) for s in live)
    assert cheapest(patterns, targets, most)[0] == full(most) and cheapest(patterns, targets, most + 1)[0] < full(most + 1)


def test_sources_compete_for_patterns():
    once = {"a": (0.5, 1), "b": (0.5, 1)}
    assert mixing.route({("a", "b"): 100, ("a",): 100}, once, 200) == (200, {(("a", "b"), "a"): 0, (("a", "b"), "b"): 100, (("a",), "a"): 100})
    assert mixing.route({("a", "b"): 100}, once, 200)[0] == 100 and mixing.largest_total({("a", "b"): 100}, once) in range(100, 103)
    targets = {"a": (0.5, 2), "b": (0.5, 3)}
    assert mixing.largest_total({("a",): 100, ("b",): 10}, targets) in range(60, 64)
    assert mixing.route({}, targets, 10) == (0, {}) and mixing.largest_total({}, targets) == 0


def test_many_patterns_take_few_paths():
    sources = [f"s{i}" for i in range(12)]
    patterns = {tuple(s for i, s in enumerate(sources) if m >> i & 1): 1000 + m for m in range(1, 1 << 12)}
    targets = {s: (1 / 12, 1 + i % 3) for i, s in enumerate(sources)}
    import time

    began = time.time()
    most = mixing.largest_total(patterns, targets)
    reached, _ = mixing.route(patterns, targets, most)
    assert reached == sum(int(most / 12) for _ in sources) and time.time() - began < 60


def test_a_line_of_documents_starts_again():
    cuts, pieces = mixing._uses(100, [("a", 70), ("b", 60), ("c", 100)])
    assert cuts == [30, 70] and pieces == [[("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("c", 1)], [("b", 1), ("c", 1)]]
    assert mixing._uses(100, []) == ([], [[]])


def test_mix_reaches_its_shares(spark):
    r = random.Random(3)
    rows = [(i, r.choice([["a"], ["a"], ["a"], ["b"], ["c"], ["z"], [], None]), r.choice([0, 5, 10, 20])) for i in range(3000)] + [(None, ["a"], 5)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, sources array<string>, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 4), ("c", 0.15, 2), ("none", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(sizes, targets, seed=7)
    got = mix.collect()
    caps = {"a": 1, "b": 4, "c": 2}
    assert all(1 <= x.repeats <= caps[x.source] and x.n_tokens > 0 for x in got) and len({x.doc_id for x in got}) == len(got)
    total = sum(x.n_tokens * x.repeats for x in got)
    for x in mixing.reached_shares(mix, targets.dropna()).collect():
        share = 0 if x.source == "none" else {"a": 0.4, "b": 0.4, "c": 0.15}[x.source] / 0.95
        assert abs(x.reached_share - share) <= 3 * 10 / total + 1e-3
    assert sorted(map(tuple, mixing.mix_sources(sizes.repartition(5), targets, seed=7).collect())) == sorted(map(tuple, got))
    fixed = mixing.mix_sources(sizes, targets, total=1000)
    assert abs(sum(x.n_tokens * x.repeats for x in fixed.collect()) - 950) <= 30
    assert mixing.mix_sources(sizes.limit(0), targets).count() == 0


def test_document_of_two_sources(spark):
    sizes = spark.createDataFrame([(i, ["a", "b"], 10) for i in range(50)] + [(100 + i, ["a"], 10) for i in range(50)], "doc_id bigint, sources array<string>, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mix_sources(sizes, targets).collect()
    assert len(got) == len({x.doc_id for x in got}) == 100 and all(x.repeats == 1 for x in got)
    assert {x.doc_id for x in got if x.source == "b"} == set(range(50))
    alone = mixing.mix_sources(sizes.filter("doc_id < 50"), targets).collect()
    assert len(alone) == 50 and sum(x.source == "a" for x in alone) == 25


def test_copies_of_a_text_are_one_document(spark):
    rows = [(1, "one two three", "a"), (2, "one two three", "b"), (3, "one two three", "b"), (4, "four five six", "a"), (5, "", "a"), (6, None, "b"), (7, "x", None), (8, "y", "z"), (None, "w", "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("none", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    sizes = mixing.document_sizes(spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit("clash")), targets)
    assert {(x.doc_id, tuple(x.sources), tuple(sorted(x.ids.items()))) for x in sizes.collect()} == {(1, ("a", "b"), (("a", 1), ("b", 2))), (4, ("a",), (("a", 4),))}
    assert {(x.doc_id, x.source, x.repeats) for x in mixing.mix_sources(sizes, targets).collect()} == {(2, "b", 1), (4, "a", 1)}
    assert mixing.reached_shares(mixing.mix_sources(sizes.limit(0), targets), targets).count() == 4


STUFFED = [
    "cheap tyres, cheap tyres near me, best tyres, tyres coupon, cheap tyres, used tyres, tyres Norolm, cheap tyres",
    "* [http://shop.a.test/ Ula lamps]\n* [https://b.example/x Harost boots]\n* [http://c.test/?id=3 Pel watches]",
    "[click here](http://a.test/) | [click here](http://b.test/) | [click here](http://c.test/x)",
    "Brand: A | Size: 38 | Colour: red | SKU TA-99981 | €119.99\nBrand: B | Size: 37 | Colour: blue | SKU IS-6621 | €265.99",
    "#roof#repair#roof117 #near #roof #roof12 #coupon",
    "visit lora dot example\nwww . golca . invalid/early\nhxxp://talren[.]test",
    "u.s.e.d. .t.y.r.e.s / n3w us3d tyr3s T0rith / USED TYRES ONLINE / used tyres near Torith / ✔ used tyres / used tyres",
    "купить сапоги; сапоги; доставка; купить сапоги; сапоги недорого; доставка; купить; сапоги",
    "[[Nara River]] ★ [[Siege of Lum]] ★ [[Mayor of Sal]] ★ [[Vel Yar]]",
]
SOUND = [
    "The tramway of Norolm was opened in 1904 and closed after the flood. It had nine stations, of which two are left.",
    "* [[Nal valley]] – rebuilt quarry that was surveyed in 1783\n* [[Hel province]] – regional lighthouse that fell out of use in 1780",
    "'''Tor''' may refer to:\n* [[Tor (library)]], a steep fishery in Belrenur\n* [[Tor (orchid)]], a southern reservoir in Bel",
    '{| class="wikitable"\n! Date !! Home\n|-\n| 19 April || Vinya\n|-\n| 26 April || Renor\n|}',
    "Inv. 9221 | small orchard | brass | 28 cm | gift of M. Bel, 1916\nInv. 1858 | wooden mine | linen | 51 cm | gift of D. Ral, 1890",
    "* [http://a.test/ Garur], According to the census of 1965 the town had a theatre and a harbour of its own.",
    "We left the chapel in July / and the ferry lay still. /\nO tramway of Kesara, / sing low, sing low, sing low;\nO tramway of Kesara, / sing low, sing low, sing low;",
    "Undid revision 15804286 by [[Special:Contributions/Yar|Yar]]",
    "copyedit; typo",
    "Мост был открыт в 1749 году и закрыт после наводнения. О ранней истории крепости известно мало. Мост был открыт в 1750 году и закрыт после наводнения.",
    "* 1721: The glacier lost its charter.\n* 1732: The orchestra moved to Velond.\n* 1736: The tramway lost its charter.",
    "",
    None,
    " \n\t",
]


def test_stuffed_pages(spark):
    texts = STUFFED + SOUND + STUFFED[:1]
    mixed = SOUND[0] * 4 + "\n" + STUFFED[0]
    got = {x.doc_id for x in stuffing.stuffed_pages(docs(spark, [*texts, mixed])).collect()}
    assert got == {*range(len(STUFFED)), len(STUFFED) + len(SOUND)}
    assert stuffing.stuffed_pages(docs(spark, texts).limit(0)).count() == 0
    assert stuffing.stuffed_pages(docs(spark, STUFFED).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")).count() == 0


PROSE = [  # languages that the operator knows nothing about
    "Kasaba, ırmağın iki yakasında kurulmuş ve on dokuzuncu yüzyılda demiryolunun gelmesiyle büyümüştür. Eski köprü selden sonra yeniden yapıldı. Bugün nüfusunun çoğu tarımla uğraşır; pazar her salı kurulur. Müze, belediyenin eski binasında yer alır ve yazın açıktır.",
    "Kaupunki sijaitsee joen rannalla, ja sen satama avattiin vuonna 1904. Asukkaat elivät pitkään kalastuksella ja metsätöillä. Vanha kirkko paloi sodan aikana, mutta se rakennettiin uudelleen. Nykyään museossa on pieni kokoelma.",
    "A város a folyó partján fekszik, és a vasút érkezése után gyorsan növekedett. A régi hidat az árvíz elvitte, később újjáépítették. A múzeumot nyáron sokan látogatják. Lakóinak többsége a földekből él.",
    "이 마을은 강가에 자리 잡고 있으며 철도가 놓인 뒤 빠르게 성장하였다. 옛 다리는 홍수로 무너졌다가 다시 세워졌다. 박물관은 여름에만 문을 연다. 주민들은 대부분 농사를 짓는다.",
    "Η πόλη βρίσκεται στην όχθη του ποταμού και αναπτύχθηκε μετά την άφιξη του σιδηροδρόμου. Η παλιά γέφυρα καταστράφηκε από την πλημμύρα και ξαναχτίστηκε. Το μουσείο ανοίγει το καλοκαίρι.",
    "Miasto leży nad rzeką i rozwinęło się po doprowadzeniu kolei. Stary most zniszczyła powódź, lecz odbudowano go. Muzeum otwarte jest latem.",
    "这座城市位于河畔，铁路通车后发展迅速。旧桥毁于洪水，后来重建。博物馆只在夏天开放。居民大多务农。",
    "หมู่บ้านนี้ตั้งอยู่ริมแม่น้ำและเติบโตขึ้นหลังจากมีทางรถไฟ สะพานเก่าถูกน้ำท่วมพัดพังและสร้างขึ้นใหม่",
]
RUNS = ["tyres, used tyres, cheap tyres", "tyres near me, tyres coupon", "used tyres online, best tyres", "tyres sale, cheap tyres near me"]
DISGUISED = [
    "\n".join("Expected: " + x for x in RUNS),
    "\n".join("[[User:Bob]] " + x for x in RUNS),
    "the best of tyres for the car, tyres of the best, tyres for the winter\nthe tyres for the best car of the tyres\nbest tyres for the winter of the car\nthe price of the tyres for the car of the tyres\ntyres for the car, the tyres of the winter",
    "\n".join(["best tyres for the best price of tyres"] * 5),
]


def test_prose_of_any_language_and_runs_with_grammar_or_prefixes():
    assert [t for t in PROSE if stuffing.is_stuffed(t)] == [] and all(map(stuffing.is_stuffed, DISGUISED))


def test_rows_of_one_doc_id_are_judged_apart(spark):
    half = SOUND[0] * 2 + "\n" + STUFFED[0]
    assert not stuffing.is_stuffed(half)
    rows = spark.createDataFrame([(1, half), (1, half), (1, half), (2, STUFFED[0]), (2, STUFFED[0])], "doc_id bigint, text string")
    assert [x.doc_id for x in stuffing.stuffed_pages(rows).collect()] == [2]


def test_common_shapes(spark):
    got = stuffing.common_shapes(docs(spark, [STUFFED[1], STUFFED[1], SOUND[0], None, ""])).collect()
    links = [x for x in got if x.kind == "links"]
    assert sum(x.n_lines for x in links) == 6 and {x.n_pages for x in links} == {2} and {x.kind for x in got} == {"links", "text"}


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_without_sql(spark, whole):
    from palimpsest.llm import queries as Q
    from palimpsest.shared import table

    rows = {r.doc_id: r.text for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in Q.p7_ids(spark, DATA).collect()} == {i: whole(t) for i, t in rows.items()}
    assert {r.doc_id for r in Q.p9_found(spark, DATA).collect()} == {i for i, t in rows.items() if stuffing.is_stuffed(t)}
    assert sum(r.n_lines for r in Q.p9_shapes(spark, DATA).collect()) == sum(n for t in rows.values() for n, _ in stuffing.page_shapes(t)[0].values())
    targets = {r.source: r for r in table(spark, DATA, "mix_targets").collect()}
    mix = Q.p8_mix(spark, DATA).collect()
    used = {}
    for r in mix:
        used[rows[r.doc_id]] = used.get(rows[r.doc_id], 0) + r.repeats
        assert r.n_tokens == len(whole(rows[r.doc_id])) > 0
    assert mix and all(r.repeats <= targets[r.source].max_repeats and used[rows[r.doc_id]] <= targets[r.source].max_repeats for r in mix)
    total = sum(r.n_tokens * r.repeats for r in mix)
    for r in Q.p8_shares(spark, DATA).collect():
        own = [x for x in mix if x.source == r.source]
        assert r.tokens == sum(x.n_tokens * x.repeats for x in own) and r.documents == len(own) and abs(r.reached_share - r.tokens / total) < 1e-9


@pytest.mark.parametrize("text", [" " * 200_000, "!" * 200_000 + "x", "<ref>" * 40_000, "[[" * 100_000, "a\t" * 100_000, "http://" + "a." * 100_000, "&" * 200_000, "#a" * 100_000, "a, " * 100_000, "[[a " * 50_000, "a.b. " * 50_000, " -" * 100_000])
def test_long_runs_end(text):
    import time

    began = time.time()
    stuffing.is_stuffed(text)
    tokens._cutter(tokens.BYTE_BPE)(text)
    assert time.time() - began < 5

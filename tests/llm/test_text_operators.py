"""Encoding repair, packing, leaks and sentences: edge cases, brute force, round trips."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import encodings, leaks, packing
from lodestar.llm.sentences import Rules, split_sentences


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- encodings -------------------------------------------------------------------------------------------------------

CLEAN = [
    "the café of {0} is a naïve place – it’s on {0}’s “list” for £{1}…",
    "La bibliothèque de {0} a été rénovée en {1}. Le prix reste élevé, très élevé.",
    "Die Brücke in {0} wurde am 3. März {1} eröffnet, sie ist größer und schön.",
    "Цена выросла на {1}, то есть почти вдвое, а рынок в городе стоит",
    "Το μουσείο στο {0} χτίστηκε το {1} και είναι παλιός",
    "这里的图书馆很旧，但是还能用。价格{1}元。",
    "この博物館は静かだと思いますか？値段は約{1}円です。",
    "SÃO {0}: o pão e o grão, CORAÇÃO da terra, ÂNGULO {1}",
    "the tree of {0}: ├── {1} └── end",
]


def _records(spark, n=900):
    rnd = random.Random(11)
    chains = ["utf-8>cp1252", "utf-8>cp437", "utf-8>mac_roman", "cp1251>cp1252", "cp1253>cp1252", "gbk>cp1252", "shift_jis>cp1252", "utf-8>cp1252>utf-8>cp1252", "cp1252>cp437"]
    data, truth = [], {}
    for i in range(n):
        text = rnd.choice(CLEAN).format(rnd.choice(["Rilo", "Denlo", "Tamer"]), rnd.randint(100, 2000))
        bad = text
        if i % 12 == 0:
            try:
                for w, r in encodings.CHAINS[rnd.choice(chains)]:
                    table = encodings._table(r)
                    bad = "".join(table[b] for b in bad.encode(w))
            except UnicodeEncodeError:
                bad = text
        if bad != text:
            truth[i] = text
        data.append((i, bad, f"part-{i % 3}", "line", False))
    return spark.createDataFrame(data, "id int, text string, source string, kind string, folded boolean"), truth


def test_garbled_records_are_found_and_restored(spark):
    df, truth = _records(spark)
    found = {r.id: r for r in encodings.find_garbled(df).collect()}
    assert set(truth) - set(found) == set()
    assert len(set(found) - set(truth)) <= 2
    right = sum(found[i].restored == t for i, t in truth.items())
    assert right >= 0.9 * len(truth)


def test_lost_records_of_a_source_vouch_for_each_other(spark):
    """Letters replaced at random, by no chain: a source full of them shows it, and the share of the lost is re-estimated."""
    rnd, noise = random.Random(5), sorted(c for c in encodings._NOISE if c.isalpha())
    data, lost = [], set()
    for i in range(1200):
        text = rnd.choice(CLEAN).format(rnd.choice(["Rilo", "Denlo", "Tamer"]), rnd.randint(100, 2000))
        if i % 3 == 0 and rnd.random() < 0.4:
            text = "".join(c if c.isascii() else rnd.choice(noise) for c in text)
            lost.add(i)
        data.append((i, text, f"part-{i % 3}", "line", False))
    df = spark.createDataFrame(data, "id int, text string, source string, kind string, folded boolean")
    found = {r.id for r in encodings.find_garbled(df).collect()}
    assert len(found - lost) <= 2
    assert len(lost & found) >= 0.9 * len(lost)


def _chunk(texts, folded=False, sources=None):
    cols = [texts, sources or ["s"] * len(texts), ["line"] * len(texts), [folded] * len(texts), list(range(len(texts)))]
    return encodings.Chunk.of(pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=list("abcde")), lambda w, f: encodings._worked_out(w, f, encodings.PairModel()))


def test_share_of_the_lost_counts():
    few, many = (np.array([[0.0] * encodings.N_CHAINS + [0.5, s, 0.0]]) for s in (1e-9, 0.5))
    weigh = lambda share: _chunk(["z\u0113\u00fe\u00f0"]).posteriors(encodings.PairModel(), share)[0][0, encodings.PLACE[encodings.LOST_CHAIN]]
    assert weigh(many) > weigh(few)


def test_whole_arrays_score_as_single_steps():
    rnd = np.random.default_rng(3)
    pair = encodings.PairModel(rnd.integers(0, 40, encodings.PAIRS).astype(float), rnd.integers(0, 400, encodings.SINGLES).astype(float))
    texts = ["caf\u00e9", "\u041f\u0440\u0438", "\u56fe", "x", "\U0001f600z"]
    assert pair.scores(*encodings._stream(texts)) == pytest.approx([pair(t) for t in texts], rel=1e-5)


def test_chunk_posteriors_match_a_plain_computation():
    """Record by record, token by token."""
    texts = ["caf\u00c3\u00a9 and caf\u00c3\u00a9\t\u00e9t\u00e9", "\u00e9t\u00e9", "x \ufffd y", "\u041f\u0440\u0438\u0432\u0435\u0442 caf\u00c3\u00a9"]
    rnd = np.random.default_rng(5)
    pair = encodings.PairModel(rnd.integers(0, 40, encodings.PAIRS).astype(float), rnd.integers(0, 400, encodings.SINGLES).astype(float))
    share = encodings._first_shares()
    weight, _, _ = _chunk(texts).posteriors(pair, share[None, :])
    for text, got in zip(texts, weight, strict=True):
        odd = [t for t in encodings._tokens(text) if not t.isascii()]
        score = {encodings.NONE: sum(map(pair, odd)) + np.log(share[encodings.PLACE[encodings.NONE]])}
        for chain in {c for t in odd for c in encodings._repairs(t, False, pair)}:
            total = np.log(share[encodings.PLACE[chain]])
            for t in odd:
                r = encodings._repairs(t, False, pair).get(chain)
                total += pair(t) if r is None else np.logaddexp(np.log(1 - encodings.SOUND) + pair(r), np.log(encodings.SOUND) + pair(t))
            score[chain] = total
        if "\ufffd" in text:
            assert got[encodings.PLACE[encodings.REPLACED]] == 1
            continue
        ratio = np.log(got[encodings.PLACE[encodings.NONE]]) - score[encodings.NONE]
        for c, s in score.items():
            w = got[encodings.PLACE[c]]
            assert w == 0 or np.log(w) - s == pytest.approx(ratio, abs=1e-3)


def test_many_sources_are_joined_instead_of_held(spark, monkeypatch):
    """The same result whether the shares of the groups travel with the tasks or are joined to the chunks."""
    df, _ = _records(spark, 400)
    df = df.withColumn("source", F.concat("source", F.col("id") % 20))
    held = rows(encodings.find_garbled(df).select("id", "chain", "restored"))
    monkeypatch.setattr(encodings, "GROUPS", 3)
    monkeypatch.setattr(encodings, "CHUNK_RECORDS", 50)
    assert rows(encodings.find_garbled(df).select("id", "chain", "restored")) == held


def test_encoding_edges(spark):
    schema = "id int, text string, source string, kind string, folded boolean"
    data = [(1, None, "s", "k", False), (2, "", "s", "k", False), (3, "plain ascii", None, "k", False), (4, "lost � here", None, "k", False), (4, "lost � here", None, "k", False), (5, "é" + "x" * 100_000, "s", "k", True)]
    got = encodings.find_garbled(spark.createDataFrame(data, schema).withColumn("chain_", F.lit(1)))
    assert [(r.id, r.chain, r.restored) for r in got.collect() if r.id != 5] == [(4, "replaced", None)] * 2
    assert encodings.find_garbled(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        encodings.find_garbled(spark.createDataFrame([], schema), 0)


@pytest.mark.parametrize("chain", sorted(encodings.CHAINS))
def test_every_chain_is_undone(chain):
    """Whatever a chain can do to a text it can undo, in lower case too where that loses nothing."""
    samples = ["café", "Привет", "Ελλάδα", "图书馆", "すごい", "박물관", "naïve"]
    done = 0
    for s in samples:
        bad = s
        try:
            for w, r in encodings.CHAINS[chain]:
                raw = bad.encode(w)
                bad = raw.decode(r) if r in encodings._MULTI else "".join(encodings._table(r)[b] for b in raw)
        except UnicodeError:
            continue
        if bad == s or bad.isascii():
            continue
        done += 1
        assert encodings.undo(bad, chain, False, encodings.PairModel()) == s
    assert done or chain.split(">")[0] in ("cp1255", "cp1256", "cp874") or chain.endswith(">latin_1") or ">gbk" in chain or ">big5" in chain or ">shift_jis" in chain or ">euc_kr" in chain


@pytest.mark.parametrize("true", range(8))
def test_unlikely_beginning_is_followed_up(true):
    """A folded token whose first character has eight readings: each is found if only what follows speaks for it."""
    token, codec, pair = "õüç" * 2, encodings._CODECS[("utf-8", "cp850")], encodings.PairModel()
    one = sorted(bytes(b).decode() for b in itertools.product(*[codec.folded[c] for c in token[:3]]))
    assert len(one) == 8
    for i, c in enumerate(one):
        pair.memo |= {(before, c): -1.0 - (10 if i == true else i / 10) for before in ("", " ")} | {(c, after): -1.0 if i == true else -40.0 for after in one} | {(c, " "): -1.0}
    pair.memo[(one[true], one[true])] = -0.5
    got = encodings.undo(token, "utf-8>cp850", True, pair)
    assert got == max(("".join(w) for w in itertools.product(one, one)), key=pair)
    assert got[0] == one[true]


# ---- packing ---------------------------------------------------------------------------------------------------------


def check_packing(docs, packs, out):
    sizes = {d: len((t or "").encode()) for d, t in docs}
    for p, cap in packs:
        mine = [r for r in out if r.pack_id == p]
        fill = {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.size
        assert all(f <= cap for f in fill.values())
        for d, n in sizes.items():
            parts = sorted((r.start_pos, r.size, r.piece, r.n_pieces) for r in mine if r.doc_id == d)
            assert sum(x[1] for x in parts) == n
            assert len(parts) == max(1, -(-n // cap)) == parts[0][3]
            assert all(x[0] == i * cap and x[2] == i for i, x in enumerate(parts))
        yield p, len(fill), -(-sum(sizes.values()) // cap)


def test_packing_is_whole_and_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 64)
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["x", "é", "图"]) * rnd.randint(1, 180)) for i in range(600)] + [(600, None), (601, ""), (602, "y" * 5000), (603, "z" * 400), (604, "z" * 401)]
    packs = [(1, 400), (2, 1000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("pack_id", F.lit("clash"))
    specs = spark.createDataFrame([*packs, (1, 400), (3, None), (None, 10), (4, 0)], "pack_id int, capacity bigint")
    out = packing.pack(df, specs)
    for _, n, least in check_packing(docs, packs, out.collect()):
        assert n <= least + 3
    assert set(rows(packing.cut_documents(out))) == {(p, d) for p, c in packs for d, t in docs if len((t or "").encode()) > c}


def test_packing_of_items_that_do_not_pair(spark, monkeypatch):
    """All containers stay poor, so nothing is to be gained by opening them again and again."""
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 16)
    docs = [(i, "x" * 60) for i in range(100)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, 100)], "pack_id int, capacity bigint"))
    assert [n for _, n, _ in check_packing(docs, [(1, 100)], out.collect())] == [100]


def test_packing_edges(spark):
    specs = spark.createDataFrame([(1, 10)], "pack_id int, capacity bigint")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(None, "abc"), (1, "abc"), (1, "abc")], "doc_id bigint, text string")
    assert packing.pack(none, specs).collect() == []
    assert packing.pack(some, specs.limit(0)).collect() == []
    assert sum(r.size for r in packing.pack(some, specs).collect()) == 9
    with pytest.raises(ValueError):
        packing.pack(some, spark.createDataFrame([(1, 10), (1, 20)], "pack_id int, capacity bigint"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(0, 9))
def test_evolution_keeps_every_item_once(sizes, seed):
    elite = packing.evolve(sizes, 50, [], seed)
    again = packing.evolve(sizes, 50, elite, seed + 1)
    for p in elite + again:
        assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
        assert p.fill == [sum(sizes[i] for i in b) for b in p.bins]
        assert max(p.fill) <= 50
        assert all(p.bins)
    assert len(again[0].bins) <= len(elite[0].bins)


# ---- leaks -----------------------------------------------------------------------------------------------------------


def brute_matches(docs, items, n):
    for d, t in docs:
        a = leaks.words(t or "")
        for i, x in items:
            b = leaks.words(x or "")
            for p in range(len(a)):
                for j in range(len(b)):
                    if p and j and a[p - 1] == b[j - 1]:
                        continue
                    k = 0
                    while p + k < len(a) and j + k < len(b) and a[p + k] == b[j + k]:
                        k += 1
                    if k >= n:
                        yield d, i, k, p, j


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abx ", max_size=30), min_size=1, max_size=4), st.lists(st.text("ab ", max_size=20), max_size=3), st.integers(1, 4))
def test_suffix_search_matches_brute_force(docs, items, n):
    known = leaks.Items(list(enumerate(items)), n)
    shard = leaks.Shard.of(pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["doc_id", "text"]), n)
    got = set()
    for p, j, k in leaks.search_shard(shard, known):
        d = int(np.searchsorted(shard.starts, p, "right")) - 1
        got.add((d, known.owner[j], k, p - int(shard.starts[d]), int(known.place[j])))
    assert got == set(brute_matches(list(enumerate(docs)), list(enumerate(items)), n))


def test_leaks_ignore_case_and_what_stands_between(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten eleven straße THIRTEEN"
    docs = [
        (1, "zero ONE, two_three four-five six SEVEN eight «nine» ten\neleven STRASSE end"),
        (2, "one two three four five six seven eight nine ten eleven other"),
        (3, None),
        (4, ""),
        (None, item),
        (5, "x " * 50_000 + item),
        (6, item + " " + item),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (8, "short"), (9, None), (10, "a new item " + item)], "item_id bigint, text string")
    want = [(d, i) for d in (1, 5, 6, None) for i in (7, 10)]
    for shard_words, block in ((1 << 20, 32 << 20), (5, 64)):
        monkeypatch.setattr(leaks, "SHARD_WORDS", shard_words)
        monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
        found = leaks.find_matches(df, items)
        assert rows(leaks.leaked_items(found)) == sorted(want, key=repr)
    at = {(r.doc_id, r.item_id, r.doc_word): r for r in found.collect()}
    assert docs[0][1][at[1, 7, 1].start_pos : at[1, 7, 1].end_pos].startswith("ONE, two_three")
    assert at[1, 7, 1].n_words == 12 and at[6, 7, 0].n_words == 13 and (6, 7, 13) in at
    assert sorted(r.doc_id for r in leaks.without_leaks(df, found).where("doc_id is not null").collect()) == [2, 3, 4]


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert leaks.find_matches(docs, items).collect() == []
    assert leaks.find_matches(full, items, least=1).collect() == []
    assert leaks.find_matches(docs, full.withColumnRenamed("doc_id", "item_id"), least=1).collect() == []


# ---- sentences -------------------------------------------------------------------------------------------------------

SENTENCES = [
    ["Dr. Rilo met Mr. and Mrs. Tamer at 9 a.m. on Monday.", "It was late."],
    ["It was sold by Torlo Ltd.", "1757 was a cheap year."],
    ["J. R. Rilo and the U.S. office of Torlo Inc. signed."],
    ["See fig. 5, p. 12 (cf. Sec. 5.2) of vol. 3, e.g. the map.", "Prices rose to 3.50 dollars."],
    ["Visitors may enter until 8 p.m.", "eRilo sells parts.", "pH values above 7.5 harm it."],
    ['"Is it open?" asked Denlo.', "“Stop!” she cried.", "The label said “Do not open.”", "Next."],
    ['"The bridge is shut today.', 'Come back after noon."', "When Rilo asked, nobody knew."],
    ["(It was moved in 1840.)", "Wait, what?!", "The bridge is old!!!", "Nobody came …", "It slowed down ... and then failed."],
    ["Use it on weekdays.", "The"],
    ["Die Straße wurde am 2. März 1884 eröffnet.", "Im 9. Jahrhundert war sie alt, z. B. bei Nr. 820.", "„Ist sie offen?“, fragte Dr. Pello.", "Offen bis 20 Uhr usw."],
    ["« Où est la forêt ? » demanda Mme Lowy.", "Il a hésité… puis il a fermé.", "M. Nelo paie env. 3,5 % de plus."],
    ["—¿Está rápido? —preguntó la Dra. Talo.", "Según EE. UU., mide 3.5 metros.", "¡Qué bueno!", "¿Cuánto cuesta?"],
    ["L'ing. Rilo (v. pag. 63) conferma.", "Il sig. Casti ha detto: «È vicino»."],
    ["См. рис. 10 на стр. 5: там сад.", "Новый рынок им. Рилова стоит, т. е. открыт.", "«Где музей?» — спросил Рило.", "В 1446 г. недалеко от села."],
    ["Ο κ. Ρίλο είπε ότι είναι παλιός, π.χ. εδώ.", "Πόσο κοστίζει;", "«Πού είναι;» ρώτησε ο Ρίλο."],
    ["डॉ. लोसादे ने कहा।", "क्या यह नया है?", "“बाज़ार कहाँ है?” पुरीलो ने पूछा।"],
    ["قال د. كاماما إن البستان قديم.", "كم سعر الجسر؟", "«أين المصنع؟» سأل كالوفان."],
    ["یہ پل بند ہے۔", "قیمت 89.4 روپے ہے۔"],
    ["ዋጋ 44.58 ብር ነው።", "የት ነው?"],
    ['"오늘은 쉽니다."라고 로서 씨가 말했습니다.', "정말 좋아요!"],
]
GLUED = [
    ["这里的图书馆很旧，但是还能用。", "“图书馆开门了吗？”北石问道。", "南东说：“这个发票狭窄。”", "价格从4.73涨到72.44。", "真是太好了！"],
    ["値段は約65.25円です。", "「今日は休みです。」とトナは言った。", "(工場は移された。)", "すごい！"],
    ["Never leave it!", "The bridge is old.", "It opens at 9."],
    ["Offen bis 20 Uhr.", "这里很旧。", "“开门了吗？”他问道。"],
    ["See docs.Rilo.example/hinge.html for version 3.4.1 now.", "Next one."],
]


@pytest.mark.parametrize("parts", SENTENCES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\xa0", "\n\n", "\n \n"])
def test_sentences(parts, gap):
    text = gap.join(parts)
    assert [text[a:b] for a, b in Rules().spans(text)] == parts


@pytest.mark.parametrize("parts", GLUED)
def test_sentences_without_spaces_between(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in Rules().spans(text)] == parts


@pytest.mark.parametrize("mark", ["\u203d", "\u104b", "\u1c7f", "\u1945", "\ua60f", "\uabeb", "\ufe56", "\u0964", "\u2e3c", "\U00011c41"])
def test_terminators_of_all_scripts(mark):
    parts = [f"\u1c5a\u1c5b{mark}", "Next one."]
    assert [" ".join(parts)[a:b] for a, b in Rules().spans(" ".join(parts))] == parts


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["He lost his cap.", "12 people saw it."]),
        ("it", ["He lost his cap.", "12 people saw it."]),
        (None, ["I am 12.", "The dog sleeps."]),
        ("de", ["We sold 12.", "August was better."]),
        ("en", ["Das war am 12. August im Rathaus."]),
        ("EN", ["Vedi la tabella nel cap. 12 del libro."]),
        ("xx", ["Kap. 3"]),
        ("fr", ["M. Nelo"]),
    ],
)
def test_abbreviations_by_language(lang, parts):
    """The words of the sentence count before the tag; without either, every language's abbreviations count."""
    text = " ".join(parts)
    assert [text[a:b] for a, b in Rules(lang).spans(text)] == parts


def test_sentences_of_thai_headings_and_blanks():
    text = "  สถานีเก่ามาก คนจำนวน 706 คนมาทุกวัน\n\nTitle of it\n\n Text here. "
    assert [text[a:b] for a, b in Rules().spans(text)] == ["สถานีเก่ามาก", "คนจำนวน 706 คนมาทุกวัน", "Title of it", "Text here."]
    for blank in (None, "", " \n\t ", "\n\n"):
        assert Rules().spans(blank) == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB1 .!?\"“”()«»—\n\xa0。；;,ก٣д'’"), max_size=60))
def test_sentences_cover_the_text(text):
    spans = Rules().spans(text)
    covered = "".join(text[a:b] for a, b in spans)
    assert "".join(covered.split()) == "".join(text.split())
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_split_sentences(spark):
    docs = [(1, "One. Two."), (2, None), (3, " "), (None, "Three."), (1, "One. Two."), (4, "A b. " * 20_000), (5, '("' * 3000 + ". X")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("start_pos", F.lit("clash"))
    got = split_sentences(df)
    assert rows(got.where("doc_id = 1")) == sorted([(1, 0, 0, 4, "One."), (1, 1, 5, 9, "Two.")] * 2, key=repr)
    assert got.where("doc_id = 4").count() == 20_000
    assert got.where("doc_id is null").count() == 1
    assert got.where("doc_id in (2, 3)").count() == 0
    assert split_sentences(df.limit(0)).collect() == []

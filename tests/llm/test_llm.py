import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import encodings, history, languages, neardups, neighbours, packing, scans, splitting, tokens  # noqa: E402


def test_encoding_stitches_long_texts(spark):
    texts = ["", None, "short text", "naïve – 中文 " * 40, "a" * 300, " " * 300 + "x", "it's 12,345 we'll\n\n see" * 30]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    e = tokens.encoder()
    for chunk in (64, 16_384):
        out = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, chunk_chars=chunk, overlap_chars=16).collect()}
        assert out == {i: e.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.decode(out[3]) == texts[3]
    assert tokens.encode_corpus(df.where("false")).count() == 0


def test_packing_places_all(spark):
    own = np.random.default_rng(1)
    sizes = [0, 0, 5, 100, 101, 350] + own.integers(1, 100, 500).tolist()
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)] + [(9_999, None)], "doc_id bigint, tokens bigint")
    out = packing.fill_containers(df, spark.createDataFrame([(1, 100), (1, 100), (2, None)], "budget_id int, capacity int")).toPandas()
    assert out.groupby("container").tokens.sum().max() <= 100
    assert out.groupby("doc_id").tokens.sum().to_dict() == {i: s for i, s in enumerate(sizes)} | {9_999: 0}
    assert out[out.doc_id.isin([i for i, s in enumerate(sizes) if s <= 100])].groupby("doc_id").size().max() == 1
    assert out.container.nunique() <= 1.05 * -(-sum(sizes) // 100) + 1


def test_packing_keeps_bounded_bins_open():
    where, still = packing.pack([60] * 20, 100, 3)
    assert len(set(where)) == 20 and len(still) <= 3


@pytest.mark.parametrize("text", ["x" * 9_000, "One sentence here. " * 400, "第一句话。" * 900, "Head | 1\n[Rows]\n" + "\n".join(f"cell {i} | {i}" for i in range(900)), "H" * 3_000 + "\n[Rows]\n" + "a | b\n" * 900])
def test_splitting_covers_text(text):
    parts = splitting.split_text(text)
    assert len(parts) > 1 and all(len(p) <= 2_600 for _, _, p in parts)
    at = parts[0][0]
    for a, b, _ in parts:
        assert a <= at + len("\n[Rows]\n") and at - a <= 250
        at = b
    assert at == len(text)


def test_splitting_renumbers(spark):
    rows = [(1, "d", 0, "a b " * 1_000, None, "h"), (2, "d", 1, None, "text", None), (2, "d", 1, None, "text", None), (3, "d", 2, "short", "text", "h")]
    out = splitting.split_chunks(spark.createDataFrame(rows, "id bigint, document_id string, ordinal int, text string, locator string, text_hash string")).orderBy("ordinal").collect()
    assert [(r.chunk_id, r.ordinal) for r in out] == [(1, 0), (1, 1), (2, 2), (3, 3)] and out[1].locator == "part 2"


def test_neighbours_against_brute_force(spark):
    own = np.random.default_rng(2)
    x = own.standard_normal((600, 64)).astype(np.float32)
    x[1:40] = x[0]
    rows = [(f"{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("bad", [0.0] * 64), ("nan", [float("nan")] * 64), ("null", None), ("len", [1.0])]
    df = spark.createDataFrame(rows, "text_hash string, vector array<float>")
    out = neighbours.nearest(df, block=64, range_rows=2_000).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(np.float64) @ u.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    hit = 0
    got = out.groupby("text_hash").neighbour.apply(set)
    for i in range(40, 600):
        hit += len({f"{j:04d}" for j in np.argsort(-s[i], kind="stable")[:5]} & got[f"{i:04d}"]) / 5
    assert len(got) == 600 and hit / 560 > 0.9
    assert got["0039"] == {"0000", "0001", "0002", "0003", "0004"}
    assert neighbours.nearest(df.where("false")).count() == 0
    one = np.random.default_rng(3).standard_normal((40, 640)).astype(np.float32)
    at, best = neighbours._top(one, 7)
    assert (np.sort(best, axis=1) == np.sort(one, axis=1)[:, -7:]).all() and (np.take_along_axis(one, at, 1) == best).all()


def test_near_pairs_against_brute_force(spark):
    import hashlib

    own = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3_000)]
    base = [list(own.choice(words, 60)) for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:50], *own.choice(words, 8)]) for b in base] + ["too short", None, ""]
    rows = [(hashlib.sha256((t or "").encode()).hexdigest(), t) for t in texts]
    df = spark.createDataFrame(rows + rows[:5], "text_hash string, text string")
    got = {(r.text_hash_a, r.text_hash_b) for r in neardups.near_pairs(df).collect()}
    sets = {h: set(zip(w, w[1:], w[2:])) for h, t in rows if t and len(w := neardups.words(t)) >= 30}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert got == want and len(want) == 30
    assert neardups.near_groups(df).count() == 60 and neardups.near_pairs(df.where("false")).count() == 0


def _posted(sets, similarity):
    order = np.zeros(neardups.CELLS, np.uint8)
    own, flat, place, sizes = neardups.prefixes(sets, order, similarity)
    bits = neardups.sketches(sets)
    widths = np.array([len(x) for x in bits])
    found = neardups.Sketches(np.concatenate(bits).view(np.uint64), np.cumsum(widths) - widths, widths, sizes.astype(np.int64))
    blocks = list(neardups.met(np.arange(len(sets)), sizes.astype(np.int64), own, flat.astype(np.uint32), place, similarity))
    return found, [np.concatenate(x) for x in zip(*blocks)]


def test_ring_prunes_before_the_whole_distance_and_loses_nothing():
    own = np.random.default_rng(4)
    common = own.integers(0, 1 << 63, 4_000).astype(np.uint64)
    sets = []
    for k in range(300):
        # Much in common with everyone, too little to be alike; every third has a near copy of 0.50 to 0.64, some of them long.
        size = 120 if k % 10 else 1_500
        base = np.concatenate([own.choice(common, size // 3, replace=False), own.integers(0, 1 << 63, size - size // 3).astype(np.uint64)])
        sets.append(np.unique(base))
        if k % 3 == 0:
            keep = int(len(base) * (0.667 + 0.03 * (k % 5)))
            sets.append(np.unique(np.concatenate([base[own.permutation(len(base))[:keep]], own.integers(0, 1 << 63, len(base) - keep).astype(np.uint64)])))
    for similarity in (0.5, 0.6, 0.8):
        found, (i, j, start) = _posted(sets, similarity)
        alive, left = neardups.ring(found, i, j, start, similarity)
        kept = {(min(a, b), max(a, b)) for a, b in zip(i[alive].tolist(), j[alive].tolist())}
        true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= similarity * len(np.union1d(sets[a], sets[b])) - 1e-9}
        assert true <= kept and (similarity > 0.6 or len(true) >= 30)
        # The chain does the work: of the pairs that met and aren't alike, it leaves few for the whole distance.
        rest = np.array([(min(a, b), max(a, b)) not in true for a, b in zip(i.tolist(), j.tolist())])
        _, left = neardups.ring(found, i[rest], j[rest], start[rest], similarity)
        assert rest.sum() > 1_000 and left[0] < rest.sum() / 2 and left[neardups.CHAIN - 1] < rest.sum() / 20
        whole = sum(found.differences(i, j, np.full(len(i), s)) for s in range(neardups.SEGMENTS))
        within = whole <= found.sizes[i].sum(1) * (1 - similarity) / (1 + similarity) + found.sizes[j].sum(1) * (1 - similarity) / (1 + similarity) + 1e-6
        assert within[alive].all()


def test_triples_of_every_text_are_counted(spark):
    """Odd ids only, which a sample of one id in four would leave out; a triple of two texts is never taken for one that is alone."""
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) + " one two three" for k in range(5)]
    df = spark.createDataFrame([(2 * k + 1, t) for k, t in enumerate(texts)] + [(1, texts[0]), (11, None)], "id bigint, text string").coalesce(1)
    for cells in (neardups.CELLS, 4 * neardups.CELLS):
        order = neardups.rarity(df, 30, cells)
        of = [order[neardups._cell(neardups.Triples().of(t, 30), cells)] for t in texts]
        assert len(order) == cells and all((x == neardups.ALONE).sum() >= 30 and (x > neardups.ALONE).sum() >= 1 and x.min() == neardups.ALONE for x in of)
        assert (order > neardups.ALONE).sum() == (order == int(8 * np.log2(6))).sum() == 1
    assert not neardups.rarity(df.where("false"), 30).any()


def test_texts_with_candidates_are_marked(spark):
    own = np.random.default_rng(23)
    ids = [0, (1 << 60) - 1, *own.integers(0, 1 << 60, 500).tolist()]
    bits = neardups.marked(spark.createDataFrame([(i,) for i in ids * 2], "id bigint"), neardups.CELLS)
    cell = np.array(ids) >> 40
    assert len(bits) == neardups.CELLS // 8 and (bits[cell >> 3] >> (cell & 7) & 1).all() and np.bitwise_count(bits).sum() == len(set(cell.tolist()))
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(f"{i:015x}", " ".join([*words, f"x{i}"])) for i in range(6)] + [("f" * 15, " ".join(map(str, range(90))))], "text_hash string, text string")
    assert neardups.near_pairs(df).count() == 15


def test_tiles_find_every_start():
    own = np.random.default_rng(21)
    common, sets = own.integers(0, 1 << 63, 400).astype(np.uint64), []
    for k in range(260):
        size = (40, 90, 230, 700)[k % 4]
        base = np.concatenate([own.choice(common, size // 3, replace=False), own.integers(0, 1 << 63, size - size // 3).astype(np.uint64)])
        sets += [np.unique(base), np.unique(np.concatenate([base[size // 5 :], own.integers(0, 1 << 63, size // 5).astype(np.uint64)]))]
    found, (i, j, start) = _posted(sets, 0.5)
    flat = lambda x: {(min(a, b), max(a, b), s) for a, b, s in zip(*(y.tolist() for y in x))}
    posted = neardups.prefixes(sets, np.zeros(neardups.CELLS, np.uint8), 0.5)
    tiled = [np.concatenate(x) for x in zip(*neardups.met(np.arange(len(sets)), posted[3].astype(np.int64), posted[0], posted[1].astype(np.uint32), posted[2], 0.5, found))]
    alive, left = neardups.ring(found, i, j, start, 0.5)
    again, same = neardups.ring(found, *tiled, 0.5)
    assert flat((i[alive], j[alive], start[alive])) == flat([x[again] for x in tiled]) and left == same
    assert flat(tiled) < flat((i, j, start)) and len(tiled[0]) < 0.6 * len(i)


def test_sketches_of_middling_texts_are_not_full():
    """Texts of a few hundred triples with little in common: as many pairs as texts squared, none of which may be left for the exact comparison."""
    own = np.random.default_rng(22)
    common = own.integers(0, 1 << 63, 1_000).astype(np.uint64)
    sets = [np.unique(own.choice(common, 250, replace=False)) for _ in range(300)]
    found, _ = _posted(sets, 0.5)
    i, j = np.triu_indices(len(sets), 1)
    alive, _ = neardups.ring(found, i, j, np.zeros(len(i), np.int64), 0.5)
    assert len(alive) == 0


def test_heads_of_sketches():
    sizes = [np.arange(8), np.arange(8) * 60_000, np.zeros(8, np.int64) + 65_535]
    rows = [np.concatenate([neardups.head(s), np.zeros(8 << k, np.int64)]) for k, s in enumerate(sizes)]
    widths = np.array([len(r) for r in rows])
    got, heads = neardups.sizes_of(np.concatenate(rows), np.cumsum(widths) - widths, widths)
    assert (got == np.stack(sizes)).all() and heads.tolist() == [2, 4, 2]


def test_packed_texts_come_back():
    own = np.random.default_rng(31)
    batches = []
    for most in (200, 60_000, 100_000):
        counts = np.array([1, 300 if most > 200 else 3, 2])
        bits = [np.concatenate([neardups.head(np.full(8, most)), own.integers(-(1 << 63), 1 << 63, 8 << k, dtype=np.int64)]) for k in range(3)]
        batches.append((np.array([-(1 << 63), 0, (1 << 60) - 1]), counts, own.integers(0, 1 << 32, counts.sum()).astype(np.uint32), np.minimum(own.integers(0, most, counts.sum()), neardups.FAR_PLACE), bits))
    got = neardups.unpack([neardups.pack(*x) for x in batches])
    bits = [x for b in batches for x in b[4]]
    want = [*(np.concatenate([b[k] for b in batches]) for k in range(4)), np.array([len(x) for x in bits]), np.concatenate(bits)]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(got, want)) and len(got) == len(want)


def test_texts_move_in_few_bytes(spark):
    """Texts whose triples are all common go to most parts; what they take there is little more than their sketch."""
    own = np.random.default_rng(32)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(w for at in own.integers(0, 570, 3) for w in words[at : at + 30]) for _ in range(1_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, *(getattr(store, f"stageList$default${k}")() for k in range(2, 6)))
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    parts, before = spark.conf.get("spark.sql.shuffle.partitions"), moved()
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        assert neardups.candidates(df, 0.5, 30).count() > 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert moved() - before < 1_500_000


def test_hot_triples_are_spread(spark):
    own = np.random.default_rng(12)
    part, often, block = own.integers(0, 40, 500), np.full(500, 950), own.integers(0, 1 << 16, 500)
    at, to = neardups.spread(np.full(500, 7), often, block, 40, 100)
    where = [set(to[at == k].tolist()) for k in range(500)]
    assert all(where[a] & where[b] for a in range(0, 500, 7) for b in range(500)) and len(set(to.tolist())) > 20
    assert (neardups.spread(part, np.zeros(500, np.int64), block, 40, 100)[1] == part).all()
    words = [f"w{i}" for i in range(400)]
    base = list(own.choice(words, 60))
    texts = [" ".join([*base[:k], f"x{k}", f"y{k}", *base[k:]]) for k in range(0, 60, 3)]
    df = spark.createDataFrame([(f"{i:015x}", t) for i, t in enumerate(texts)], "text_hash string, text string")
    assert neardups.near_pairs(df, hot=4).count() == neardups.near_pairs(df).count() == 190


def test_near_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.5 to 0.6, exactly 0.5 among them, of short and of long texts: none may be lost."""
    own = np.random.default_rng(8)
    vocabulary, texts = [f"w{i}" for i in range(5_000)], []
    for k in range(400):
        n = 78 if k % 4 else 780
        shared = (2 * n + 2) // 3 + k % 5 * n // 78
        base = list(own.choice(vocabulary, n + 2))
        texts += [base, [*base[: shared + 2], *own.choice(vocabulary, n - shared)]]
    sets = [{*zip(t, t[1:], t[2:])} for t in texts]
    s = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert min(s) == 0.5 and max(s) < 0.6
    df = spark.createDataFrame([(f"{i:064x}"[::-1], " ".join(t)) for i, t in enumerate(texts)], "text_hash string, text string")
    got = {tuple(sorted((int(r.text_hash_a[::-1], 16), int(r.text_hash_b[::-1], 16)))) for r in neardups.near_pairs(df).collect()}
    assert got == {(i, i + 1) for i in range(0, 800, 2)}


def test_small_world_finds_every_key():
    own = np.random.default_rng(5)
    keys = np.unique(own.integers(0, 1 << 63, 5_000).astype(np.uint64) * np.uint64(2))
    at, beam = history.tuned_search(keys, history.build_graph(keys), keys)
    assert (keys[at] == keys).all() and beam <= history.MOST_BEAM


def test_repeats(spark):
    docs = [(1, "i1", "sha256:AB", "f1", 0), (2, "i2", "ab", "f2", 1), (3, "i3", None, "f3", 0), (4, "i4", None, "f4", 2), (5, "i5", "", None, 3), (6, "i6", None, None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, id string, content_hash string, fingerprint string, batch_no int")
    c = spark.createDataFrame([("i3", "aa"), ("i3", "bb"), ("i3", "cc"), ("i4", "aa"), ("i4", "bb"), ("i4", "dd"), ("i5", "aa"), ("i5", "ee"), (None, "aa"), ("i6", None)], "document_id string, text_hash string")
    assert {(r.doc_id_a, r.doc_id_b) for r in history.repeats(d, c).collect()} == {(1, 2), (3, 4)}
    assert history.repeats(d.where("false"), c).count() == 0


@pytest.mark.parametrize("name", ["utf-8 as latin-1", "utf-8 as cp437", "utf-8 as mac_roman", "cp1252 as cp1251", "utf-8 as cp1252 twice"])
def test_mending(name):
    line = "l’unité a augmenté de 5 € grâce à l’été"
    usual = {t: 900 for t in encodings.tokens(line)}
    wrong = encodings.garble(line, encodings.CANDIDATES[name])
    assert encodings.Mender(usual, {name: 9}, {}).mend(wrong) == line
    assert encodings.Mender(usual, {name: 9}, {}).mend(line) == line
    # What nobody taught is not undone.
    assert encodings.Mender(usual, {}, {}).mend(wrong) == wrong


def _corpus(taught: bool):
    """Clean documents, documents misread in one way and, with taught, their twins."""
    own = np.random.default_rng(9)
    nouns = "société unité clientèle trésorerie dépréciation activité propriété durée".split()
    lines = [" ".join(["la", str(own.choice(nouns)), "du", str(own.choice(nouns)), f"groupe{chr(97 + k)}", "a augmenté"]) for k in range(24)]
    rows = [(i, lines[i % 24]) for i in range(240)]
    wrong = lambda t: t.encode().decode("mac_roman")
    rows += [(1_000 + i, wrong(lines[i] if taught else lines[i].replace("groupe", f"division{chr(97 + i)}{i}x"))) for i in range(12)]
    rows += [(2_000 + i, wrong(f"une tout autre clause{chr(97 + i)} sur la {nouns[i]} de cette année")) for i in range(8)]
    return rows + [(3_000 + i, f"une année sans clause{chr(97 + i)} numéro") for i in range(30)]


def test_only_taught_readings_are_undone(spark):
    for taught in (True, False):
        rows = _corpus(taught)
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: r.text for r in encodings.restore(df).where("lines_restored > 0 or lost > 0").collect()}
        assert {i for i in got if i < 1_000 or i >= 3_000} == set()
        if taught:
            assert set(got) == {*range(1_000, 1_012), *range(2_000, 2_008)}
            assert got[2_000] == "une tout autre clausea sur la société de cette année"
        else:
            assert got == {}


def test_twins_beyond_the_most_usual_forms_teach(spark):
    """The clean text is the least usual of six beside its word, and the second of two forms of a clause."""
    wide = ["本公司董事会认为", "报告期内实现收入", "截至年末总资产为", "该项目预计于明年", "股东大会审议通过", "根据会计准则规定"]
    lines = [f"Alpha{w} x" for k, w in enumerate(wide) for _ in range(12 - k)] + ["Alpha" + encodings.garble(wide[-1], (("utf-8", "cp1251"),)) + " x"] * 2
    mender = encodings.learn(spark.createDataFrame([(line,) for line in lines], "text string"))
    assert "utf-8 as cp1251" in mender.learned
    bad = encodings.garble("pêche côtière", (("utf-8", "mac_roman"),))
    lines = ["La pôche câtiâre du Nord"] * 20 + ["La pêche côtière du Nord"] * 9 + [f"La {bad} du Nord"] * 2
    mender = encodings.learn(spark.createDataFrame([(line,) for line in lines], "text string"))
    assert "utf-8 as mac_roman" in mender.learned


def test_confirmed_maps_explain_something_of_their_own():
    votes = {("utf-8 as cp1252", "utf-8 as cp1250"): 20, ("utf-8 as cp1252",): 5, ("utf-8 as latin-1",): 4, ("utf-8 as cp437",): 2}
    assert encodings.confirmed(votes) == {"utf-8 as cp1252": 25, "utf-8 as latin-1": 4}


def test_wide_text_is_aligned_beside_an_anchor():
    clean, name = "合同到期之后", "gb18030 as latin-1"
    wrong = encodings.garble(clean, encodings.CANDIDATES[name])
    assert encodings.explained_beside(">Anchor", wrong[:8], clean)[name] == 8 and name in encodings.explained_beside("<Anchor", wrong[-8:], clean)
    assert encodings.explained_beside(">Anchor", "¼¾¶È½áÊø", clean) == {}


def test_texts_beside_an_anchor_are_held_against_wide_ones_only(spark):
    wide, wrong = ["合同到期之后", "本公司董事会", "股东大会审议"], encodings.garble("合同到期之后", (("utf-8", "cp1251"),))
    forms = [(">Alpha", w) for w in [*wide, wrong, "Ελληνικά"]] + [(">Beta", w) for w in wide] + [(">Gamma", w) for w in ("Ελληνικά", "Русский")]
    pairs = encodings.beside_pairs(spark.createDataFrame([(k, w, 2) for k, w in forms], "skeleton string, own string, n bigint")).collect()
    assert len(pairs) == 18 and {(r.skeleton, r.garbled, r.clean) for r in pairs} == {(k, g, w) for k, g in forms for w in wide if g != w and k != ">Gamma"}
    assert encodings.explained_beside(">Alpha", wrong, wide[0])["utf-8 as cp1251"] == len(wrong)


def test_lost_marks_are_learned_and_words_restored():
    usual = {"für": 900, "schließlich": 80, "fär": 3}
    own = encodings.Mender(usual, {}, {}, frozenset("�"))
    assert own.mend("f�r die schlie�lich x�x") == "für die schließlich x�x"


def test_learned_runs_propose_on_their_own():
    """A misreading that is no listed one is undone where twins taught it, and nowhere else."""
    usual = {"für": 90, "schließlich": 80, "Maß": 70}
    taught = encodings.Mender(usual, {}, {"ʬ": "ü", "ʘ": "ß"})
    assert taught.mend("fʬr das Maʘ und schlieʘlich ʬ") == "für das Maß und schließlich ʬ"
    assert taught.mend("Maß für ʬx") == "Maß für ʬx"
    assert encodings.Mender(usual, {}, {}).mend("fʬr das Maʘ") == "fʬr das Maʘ"


def test_restore_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "lost �"), (None, "plain")], "doc_id bigint, text string")
    out = {r.doc_id: (r.text, r.lines_restored, r.lost) for r in encodings.restore(df).collect()}
    assert out == {1: (None, 0, 0), 2: ("", 0, 0), 3: ("lost �", 0, 0), None: ("plain", 0, 0)}
    assert encodings.restore(df.where("false")).count() == 0


def test_editor_learns():
    words = "the company reported higher revenue from maintenance agreements during the reporting period which the board considers temporary".split()
    own = np.random.default_rng(6)
    proofs = []
    for i in range(60):
        w = [str(x) for x in own.choice(words, 24)]
        clean = " ".join(w) + "."
        lines = [" ".join(w[j : j + 6]) for j in range(0, 24, 6)]
        lines[1] = lines[1][:-3] + "-\n" + lines[1][-3:]
        raw = "\n".join(lines) + "."
        proofs.append((raw.replace("the", "fhe", 1).replace("\n", f"\n{i} / 157\n", 1), clean))
    usual = {w: 1_000 for w in words}
    editor = scans.train(proofs, usual)
    out = [editor.edit(a) for a, _ in proofs]
    assert sum(o[0] == b for o, (_, b) in zip(out, proofs)) > 45
    assert editor.edit(None)[0] is None and editor.edit("the board considers temporary.") == ("the board considers temporary.", 0, 0, 0)
    assert editor.edit("a | b\n[Rows]\nfhe | 1")[1:] == (0, 0, 0)


def test_editor_learns_lost_and_doubled_characters():
    words = "the company board reported for this period that holding costs were lower after maintenance".split()
    usual = {w: 1_000 for w in [*words, "annual", "profit", "estimate"]} | {"boards": 40}
    own = np.random.default_rng(11)
    wrong = {"company": "compny", "board": "boaard", "period": "perlod", "holding": "hoIding", "reported": "reportd", "maintenance": "maintennance"}
    proofs = []
    for i in range(80):
        w = [str(x) for x in own.choice(words, 14)]
        proofs.append((" ".join(wrong.get(x, x) if k % 3 == 0 else x for k, x in enumerate(w)), " ".join(w)))
    editor = scans.train(proofs, usual)
    assert editor.lost and editor.doubled
    assert editor.edit("The compny and its boaard in the perlod")[0] == "The company and its board in the period"
    # What was learned holds for other words too; usual words stay.
    assert editor.edit("annal proffit estimte")[0] == "annual profit estimate" and editor.edit("the boards report")[1:] == (0, 0, 0)
    assert scans._core("compny", "company") == ("", "a") and scans._core("boaard", "board") == ("a", "") and scans._core("clirnb", "climb") == ("rn", "m")


def test_tables_are_edited_only_where_proofs_show_tables():
    usual = {"the": 900, "revenue": 900}
    raw = "Annual Report 7\nRevenue | 2020\n[Rows]\nfhe | 1"
    assert scans.train([("fhe revenue", "the revenue")] * 50, usual).edit(raw) == (raw, 0, 0, 0)


def test_encoding_repeats_rows_of_any_length(spark):
    long = "One two three. " * 2_000
    df = spark.createDataFrame([(1, "short"), (1, long), (1, long), (None, long), (2, "x")], "doc_id bigint, text string")
    out = [(r.doc_id, len(r.ids)) for r in tokens.encode_corpus(df).collect()]
    n = len(tokens.encoder().encode_ordinary(long))
    assert sorted(out, key=str) == sorted([(1, 1), (1, n), (1, n), (None, n), (2, 1)], key=str)


def _deliveries(spark):
    own = np.random.default_rng(13)
    docs, chunks = [], []
    for i in range(260):
        same = int(own.integers(0, i)) if i and own.random() < 0.4 else None
        hashes = [f"{int(x):04x}" for x in own.integers(0, 1 << 16, int(own.integers(1, 7)))] if same is None else list(chunks[same][1])
        if same is not None and own.random() < 0.5:
            hashes[0] = f"{int(own.integers(0, 1 << 16)):04x}"
        chunks.append((f"i{i}", ["00ff", *hashes] if i % 3 else hashes))
        docs.append((i, f"i{i}", f"{i % 90:02x}" if i % 7 == 0 else None, f"sha256:{i % 50:02X}aa" if i % 11 == 0 else "", min(8, i // 25)))
    d = spark.createDataFrame(docs, "doc_id bigint, id string, content_hash string, fingerprint string, batch_no int")
    return d, spark.createDataFrame([(i, h) for i, own_hashes in chunks for h in own_hashes], "document_id string, text_hash string")


def _brute(d, c):
    sets = {}
    for r in c.collect():
        sets.setdefault(r.document_id, set()).add(r.text_hash)
    rows, out = [(r.doc_id, r.batch_no, r.content_hash, (r.fingerprint or "").removeprefix("sha256:").lower(), sets.get(r.id, set())) for r in d.collect()], set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and (a[1] > 0 or b[1] > 0):
                k = len(a[4] & b[4])
                if (a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]) or (2 * k > len(a[4]) and 2 * k > len(b[4])):
                    out.add((a[0], b[0]))
    return out


def test_batches_one_by_one_read_only_the_index(spark, tmp_path):
    d, c = _deliveries(spark)
    want = _brute(d, c)
    # Each batch is added by an index opened anew from its folder; what it is given is the batch alone.
    got, found = set(), None
    for number in range(9):
        index = history.HistoryIndex(spark, str(tmp_path / "index"))
        own = d.where(f"batch_no = {number}")
        batch = history.delivered(own, c.join(own.select("id").withColumnRenamed("id", "document_id"), "document_id", "left_semi"))
        found = index.add_batch(batch.drop("batch"), number)
        got |= {(min(r.doc_id, r.repeats), max(r.doc_id, r.repeats)) for r in found.collect()}
    assert got == want and len(want) > 100
    kept = history.HistoryIndex(spark, str(tmp_path / "index"))
    assert [(s["first"], s["last"]) for s in kept.segments] == [(0, 0), (1, 4), (5, 8)]
    assert {(r.doc_id_a, r.doc_id_b) for r in history.repeats(d, c).collect()} == want


def test_plans_stay_the_same_size_however_many_segments(spark, tmp_path):
    d, c = _deliveries(spark)
    index, scans = history.HistoryIndex(spark, str(tmp_path / "index")), []
    for number in range(3):
        index.add_batch(history.delivered(d.where(f"batch_no = {number}"), c).drop("batch"), number)
        found = index.search(spark.createDataFrame([(7,)], "key bigint"))
        scans.append(found._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert len(index.segments) == 3 and scans == [1, 1, 1]
    assert not list((tmp_path / "index").glob("near-*"))


def test_widest_beam_falls_back_to_all_points():
    own = np.random.default_rng(14)
    keys = np.unique(own.integers(0, 1 << 63, 3_000).astype(np.uint64) * np.uint64(2))
    queries = own.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    links = np.zeros((len(keys), history.NEAR + history.FAR), np.int32)  # a graph that leads nowhere
    at, beam = history.tuned_search(keys, links, queries)
    exact = history.exhaustive(keys, queries)
    assert beam == 0 and (history._away(keys, at, queries) == exact).all()
    at, beam = history.tuned_search(keys, history.build_graph(keys), queries)
    assert 0 < beam <= history.MOST_BEAM and (history._away(keys, at, queries) == exact).all()


def test_gradients_agree_with_differences():
    p = {k: v.astype(np.float64) for k, v in languages.fresh().items()}
    own = np.random.default_rng(7)
    data = own.integers(0, 256, (2, 5, languages.STRIDE)).astype(np.uint8)
    gold, mask = own.integers(0, 7, (2, 5)), np.ones((2, 5))
    loss = lambda q: -np.log(np.take_along_axis(languages.forward(q, data), gold[:, :, None], 2)).mean()
    g = languages.backward(p, languages.forward(p, data, True), gold, mask)
    for name, at in (("u", (0, 1, 2)), ("o", (3, 4)), ("b", (1, 0, 5)), ("x", (0, 1, int(data[0, 0, 1]), 3))):
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[name][at]) < 2e-3


def test_labels():
    assert languages.named("en_GB") == ["en"] and languages.named(" 中文 ") == ["zh"] and languages.named("n/a") == [] and languages.named(None) == [] and languages.named("Deutsch, fr-CA") == ["de", "fr"]
    assert languages.named("Simplified Chinese") == ["zh"] and languages.named("Swiss German") == ["de"] and languages.named("Latin American Spanish") == ["es"] and languages.named("Português de Brasil") == ["pt"]

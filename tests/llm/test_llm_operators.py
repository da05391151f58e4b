"""The operators on small tables: brute force, round trips, and odd input."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import arrowstore, bloomlm, bytesvec, components, decontam, langid, linededup, minhash, ogg, packing, quality, tokens, warc
from tests.llm.conftest import prose

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    return [*tokens.encoder(BPE).model.encode(text or "", add_special_tokens=False).ids, 0]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


# tokens


def test_cached_ids_are_the_library_s():
    texts = ["it's a test's  'll x1y2 \n\n foo \n bar baz×a ÷ <|endoftext|> don't", "", " ", "\n\n", "日本語 テスト、 a b c\x1cd e\x85f\xa0g", "a'b 's 'sx ('t) \t x", "é à,ü;ß\nÀ'é 12ab 3.4 .5", prose(500, 5)]
    small = tokens.Encoder(BPE, slot_bits=4, pool=64)  # forgets all the time
    for encode in (tokens.encoder(BPE), small, small):
        for first, ids, offsets in encode.encode([t.encode() for t in texts]):
            for k in range(len(offsets) - 1):
                assert [*ids[offsets[k] : offsets[k + 1]], 0] == library_ids(texts[first + k])


def test_borders_on_random_strings():
    r = random.Random(1)
    alphabet = "ab Z9'.,-\n\té×÷  一́s"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    for first, ids, offsets in tokens.encoder(BPE).encode([t.encode() for t in texts]):
        for k in range(len(offsets) - 1):
            assert [*ids[offsets[k] : offsets[k + 1]], 0] == library_ids(texts[first + k]), repr(texts[first + k])


# 1 and 8


def check_pieces(rows, texts):
    ids = [np.array(library_ids(t), "<u4") for t in texts]
    whole, sequences = {}, {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, zlib.crc32(bytes(r.ids))))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert sum(n for _, n in own) <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert len(sequences) - 1 <= sum(map(len, ids)) / 1024 / 0.98
    return whole, ids


def test_packing_puts_each_id_in_one_piece(spark, odd_docs):
    rows = packing.pack(odd_docs, BPE).collect()
    texts = [r.text for r in odd_docs.collect()]
    whole, _ = check_pieces(rows, texts)
    own = np.array(library_ids(prose(60_000, 2)), "<u4")
    at = 0
    for start, n, crc in sorted(whole[7, len(own)]):
        assert start == at and crc == zlib.crc32(own[at : at + n].tobytes())
        at += n
    assert at == len(own)


def test_packing_of_equal_lengths_and_of_nothing(spark, make_docs):
    text = prose(500, 3)
    rows = packing.pack(make_docs([(i, text) for i in range(40)]), BPE).collect()
    check_pieces(rows, [text] * 40)
    assert packing.pack(make_docs([]), BPE).collect() == []


def test_plan_covers_any_histogram():
    r = np.random.default_rng(0)
    for h in (r.integers(0, 50, 64), np.bincount([40] * 90, minlength=64), np.zeros(64, int), np.bincount([63] * 9 + [1] * 4, minlength=64)):
        plan = packing.Plan(h, 64)
        fill = {}
        for n in np.flatnonzero(h):
            seq, off, cut = plan.place(np.full(h[n], n), np.arange(h[n]))
            for s, o, c in zip(seq.tolist(), off.tolist(), cut.tolist(), strict=True):
                fill.setdefault(s, []).append((o, c))
                if c < n:
                    fill.setdefault(s + 1, []).append((0, n - c))
        for own in fill.values():
            own.sort()
            assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 64
        assert len(fill) == plan.sequences


def test_least_squares_converge():
    parts, r = packing.combinations(64), np.random.default_rng(3)
    for h in (r.integers(0, 500, 64).astype(float), np.bincount(np.minimum(63, r.exponential(16, 5000).astype(int)), minlength=64).astype(float)):
        h[0] = 0

        def loss(x, h=h):
            use = np.bincount(parts.ravel(), np.repeat(x, 3), 64)
            use[0] = 0
            return ((use - h) ** 2).sum()

        x = packing.solve(parts, h)
        assert x.min() >= 0 and loss(x) - loss(packing.solve(parts, h, 3000)) < 1e-3 * (h @ h)


def test_token_files_round_trip(spark, odd_docs):
    manifest = arrowstore.write_tokens(odd_docs, BPE)
    rows = arrowstore.read_tokens(spark, manifest, with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    docs = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd_docs.collect()))
    at = 0
    for r, (doc_id, _) in zip(rows, docs, strict=True):
        assert (r.doc_id if r.doc_id is not None else -1) == doc_id and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted(tuple(r.ids) for r in rows) == sorted(tuple(library_ids(t)) for _, t in docs)


def test_token_files_random_access(spark, make_docs):
    docs = make_docs([(i, prose(400, i)) for i in range(200)])
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = arrowstore.write_tokens(docs, BPE).orderBy("shard").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    file = arrowstore.SequenceFile(rows[0].path)
    flat = np.concatenate(list(file.ids()))
    assert len(flat) == rows[0].n_tokens
    last = (len(flat) - 1) // file.width
    for i in (0, last // 2, last):
        ids, mask = file.sequence(i)
        assert (ids[mask] == flat[i * file.width : (i + 1) * file.width]).all()
    assert not file.sequence(last)[1][-1] or len(flat) % file.width == 0
    sizes = [file.reader.get_batch(i).num_rows for i in range(file.reader.num_record_batches)]
    assert len(sizes) > 1 and set(sizes[:-1]) == {arrowstore.ROWS_PER_RECORD_BATCH} and sum(sizes) == last + 1
    assert arrowstore.read_tokens(spark, arrowstore.write_tokens(make_docs([]), BPE)).collect() == []


# 2


def test_warc_round_trip(spark):
    big = "".join(random.Random(4).choices("abcdefgh\n", k=700_000))
    same = "é" * 60
    pages = [(3, "u 3", same), (1, "u1", same), (2, None, None), (5, "u5", "short"), (6, "u6", "short"), (7, "u7", big), (7, "u7", big), (8, "u8", big), (None, "u", same)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, first string")
    rows = warc.read_chunks(warc.write_archives(df)).collect()
    last = [r for r in rows if r["last"]]
    assert len(last) == len(pages)
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in last)
    urn = "<urn:page:{}>".format
    want = [(urn(1), "response", None), (urn(2), "response", None), (urn(3), "revisit", urn(1)), (urn(5), "response", None), (urn(6), "response", None), (urn(7), "response", None), (urn(7), "response", None), (urn(8), "revisit", urn(7)), (urn(""), "revisit", urn(1))]
    assert kinds == sorted(want, key=lambda x: x[:2])
    parts = sorted((r for r in rows if r.record_id == urn(7)), key=lambda r: (r.chunk, r.offset))
    assert len(parts) == 6 and all(len(r.data) <= warc.CHUNK for r in parts)
    assert b"".join(bytes(r.data) for r in parts[::2]) == big.encode()
    for r in parts:
        assert r.sha256 == hashlib.sha256(big.encode()[: r.bytes]).hexdigest()
    assert {r.payload_bytes for r in last if r.record_type == "revisit"} == {120, 700_000}
    assert warc.write_archives(df.limit(0)).collect() == []


def test_warc_refuses_a_changed_payload():
    import io

    data = bytearray(b"".join(bytes(x) for x in warc.record(1, "u", b"hello" * 30, hashlib.sha256(b"hello" * 30).hexdigest(), None, False)))
    assert [r["bytes"] for r in warc.chunks(io.BufferedReader(io.BytesIO(bytes(data))))] == [150]
    data[-10] ^= 1
    with pytest.raises(ValueError):
        list(warc.chunks(io.BufferedReader(io.BytesIO(bytes(data)))))


# 3


def test_patience():
    assert linededup.patience(list("abcxdef"), list("abcydef")) == [(0, 0, 3), (4, 4, 3)]
    assert linededup.patience(list("xabcy"), list("pqabcz")) == [(1, 2, 3)]
    assert linededup.patience([], list("a")) == []
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(12))] for _ in "ab")
        blocks = linededup.patience(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in itertools.pairwise(blocks))


def test_line_dedup(spark, make_docs):
    line = [prose(14, k) for k in range(8)]
    rows = [(1, "\n".join([line[0], "short", line[1]])), (2, "\n".join(["own words", line[0], "short", line[1], "end"])), (3, "\n".join([line[0], "short", line[1]])), (4, "short\n" + line[2]), (5, None), (6, ""), (3, "\n".join([line[0], "short", line[1]]))]
    out = {(r.doc_id, i): r for i, r in enumerate(linededup.deduplicated(make_docs(rows)).orderBy("doc_id").collect())}
    text = {k[0]: r.text for k, r in out.items()}
    assert text == {1: rows[0][1], 2: "own words\nend", 3: "", 4: rows[3][1], 5: None, 6: ""}
    assert {k[0]: r.n_deleted for k, r in out.items()} == {1: 0, 2: 3, 3: 3, 4: 0, 5: 0, 6: 0}
    assert linededup.deduplicated(make_docs([])).collect() == []


def test_line_dedup_of_odd_rows(spark, odd_docs):
    out = linededup.deduplicated(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out}
    assert by[1].n_deleted == 0 and by[4].text == "" and by[9].text == "" and by[2].text is None and by[7].n_deleted == 0


def test_a_line_that_all_share_is_cut_from_all_but_the_first(spark, make_docs):
    shared = prose(60, 99)
    out = {r.doc_id: r.text for r in linededup.deduplicated(make_docs([(i, f"{prose(12, i)}\n{shared}\n{prose(12, 1000 + i)}") for i in range(60)])).collect()}
    assert shared in out[0] and all(shared not in out[i] and out[i].count("\n") == 1 for i in range(1, 60))


def test_repeated_and_moved_lines_are_cut(spark, make_docs):
    line = [prose(14, 50 + k) for k in range(6)]
    rows = [(1, "\n".join([line[0], "x", line[1], "y", line[0], line[2], line[3]])), (2, "\n".join([line[3], "own", line[0], line[2], line[0], "more", line[1], line[0], line[1]])), (3, "\n".join(["p", line[0], "q", line[0], "r", line[0], "s"]))]
    out = {r.doc_id: r.text for r in linededup.deduplicated(make_docs(rows)).collect()}
    assert out == {1: rows[0][1], 2: "own\nmore", 3: "p\nq\nr\ns"}
    assert linededup.patience(list("xaayaaz"), list("paaqaar")) == [(1, 1, 2), (4, 4, 2)]


def test_passages_of_short_lines_are_cut(spark, make_docs):
    verse = [f"w{k} of verse" for k in range(6)]
    han = "这是一个没有空格的句子用来检查重复的行是否会被删除"
    thai = "นี่คือประโยคที่ไม่มีช่องว่างระหว่างคำ"
    rows = [(1, "\n".join(["one", *verse[:4]])), (2, "\n".join(["two", *verse])), (3, "\n".join(["three", verse[0], "", *verse[1:], "3", verse[5], verse[2], "end"])), (4, f"四\n{han}\n{thai}"), (5, f"{thai}\n五五\n{han}")]
    out = {r.doc_id: r.text for r in linededup.deduplicated(make_docs(rows)).collect()}
    assert out == {1: rows[0][1], 2: "\n".join(["two", *verse[4:]]), 3: "\n".join(["three", "3", verse[5], verse[2], "end"]), 4: rows[3][1], 5: "五五"}


def test_deletions_against_brute_force():
    r = random.Random(4)
    kinds = ["", "a b c d", "e f g h i", "j k", "l m n o p q r s t u", "v", "w x y"]
    for _ in range(300):
        first, later = (r.choices(kinds, k=r.randrange(14)) for _ in "ab")
        a, at = [x for x in first if x], [j for j, x in enumerate(later) if x]
        b, want = [later[j] for j in at], set()
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if len(" ".join(b[j : j + n]).split()) >= 10:
                want |= set(at[j : j + n])
        cut = linededup.deletions(*linededup.line_hashes("\n".join(first).encode()), *linededup.line_hashes("\n".join(later).encode()))
        assert {k for x, y in cut for k in range(x, y) if later[k]} == want


def test_line_dedup_against_all_pairs(spark, make_docs):
    r = random.Random(9)
    kinds = ["", "a b c d", "e f g h i", "j k", "l m n o p q r s t u", "v", "w x y", prose(12, 1), prose(15, 2), prose(11, 3)]
    texts = [[*r.choices(kinds, k=r.randrange(1, 14)), f"own {i}"] for i in range(60)]
    texts += [list(texts[r.randrange(60)]) for _ in range(6)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(texts)]
    want = {}
    for i, own in enumerate(texts):
        at = [k for k, x in enumerate(own) if x]
        b, gone = [own[k] for k in at], set()
        for first in texts[:i]:
            a = [x for x in first if x]
            for x, y in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if len(" ".join(b[y : y + n]).split()) >= 10:
                    gone |= set(at[y : y + n])
        want[i] = [] if own in texts[:i] else [x for k, x in enumerate(own) if k not in gone and x]
    out = {x.doc_id: x.text for x in linededup.deduplicated(make_docs(rows)).collect()}
    assert {i: [x for x in t.split("\n") if x] for i, t in out.items()} == want
    assert sum(map(len, want.values())) < sum(map(len, texts)) / 2


# 4


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_myers_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, n))) for n in (9, 16))
        best = min(edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        found = decontam.distances(p, t, 4)
        assert (found[0] if found else 5) == min(best, 5)


def test_decontamination(spark, make_docs):
    item = prose(40, 7)
    near = item[:50] + "#" + item[52:120] + "qq" + item[120:]
    far = "".join(c if i % 9 else "z" for i, c in enumerate(item))
    docs = make_docs([(1, f"{prose(200, 8)} {item}, and more"), (2, f"{prose(20, 9)}\n{near.upper()}"), (3, far), (4, None), (5, ""), (6, prose(300, 10)), (7, item), (7, item)])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "!!!"), (4, prose(30, 500))], "item_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (2, 1), (7, 1), (7, 1)]
    assert {r.doc_id: r.distance for r in rows}[1] == 0 and 0 < {r.doc_id: r.distance for r in rows}[2] <= len(item) // 20
    assert sorted(r.doc_id for r in decontam.without_matches(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontam.matches(make_docs([]), bench).collect() == [] == decontam.matches(docs, bench.limit(0)).collect()


def test_decontamination_against_brute_force(spark, make_docs, monkeypatch):
    r = random.Random(12)
    words = ["ab", "ba", "abba", "a", "bab", "aab"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.randrange(6, 16))) for i in range(12)] + [(20, None), (21, " . "), (3, text(9))]
    docs = [(i, text(r.randrange(40))) for i in range(30)]
    for i in range(20):
        x = list(items[i % 12][1])
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = r.choice(["", "a", "b", "ab"])
        docs.append((100 + i, f"{text(5)} {''.join(x).upper()}, {text(4)}"))

    def least(p, t):  # the least distance of p from a part of t
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            last, row = row, [0]
            for i, x in enumerate(p, 1):
                row.append(min(last[i] + 1, row[-1] + 1, last[i - 1] + (x != c)))
            best = min(best, row[-1])
        return best

    want = []
    for d, t in docs:
        for i, x in items:
            p = decontam.normal(x)
            n = least(p, decontam.normal(t)) if p and t else 99
            if p and n <= len(p) // 20:
                want.append((d, i, n))
    assert len(want) > 12 and {n for _, _, n in want} >= {0, 1, 2}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 22, 60):  # one shard, and many
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        monkeypatch.setattr(decontam, "BUFFER_BYTES", 500)
        assert sorted((x.doc_id, x.item_id, x.distance) for x in decontam.matches(make_docs(docs), bench).collect()) == sorted(want)
        assert sorted(x.doc_id for x in decontam.without_matches(make_docs(docs), bench).collect()) == sorted({d for d, _ in docs} - {d for d, _, _ in want})
    assert (len(decontam.shards(bench)) > 3) and decontam.shards(bench.limit(0)) == []


# 5


def test_ogg_values_against_plain_ones(spark, odd_docs):
    want = []
    for d, text in ((r.doc_id, r.text) for r in odd_docs.collect()):
        raw = (text or "").encode()
        payload = raw
        while not payload or len(payload) % 64:
            payload += b"\0"
        media = ogg.encode(payload, len(raw))
        x = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in itertools.pairwise(x))
        figures = f"duration_s={len(x) / 8000:.6f};packets={-(-len(x) // 4096)};mean={sum(x) / len(x):.6f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.6f};crossings={crossings};peak={max(map(abs, x))}"
        want.append((d or 0, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), figures))
    rows = ogg.features_of(ogg.media_of(odd_docs)).collect()
    assert sorted((r.doc_id or 0, *list(r)[1:]) for r in rows) == sorted(want)
    assert ogg.features_of(ogg.media_of(odd_docs.limit(0))).collect() == []


def test_ogg_round_trip():
    r = random.Random(5)
    for n in (0, 1, 63, 64, 255, 4096, 61_440, 65_025, 300_001):
        raw = r.randbytes(n)
        payload = raw + b"\0" * (-n % 64 if n else 64)
        media = ogg.encode(payload, n)
        assert ogg.decode(media)[:2] == (payload, n)
        assert ogg.decode(media)[2][-1] == len(payload) / ogg.RATE
        bad = bytearray(media)
        bad[len(bad) // 2] ^= 4
        with pytest.raises(ValueError):
            ogg.decode(bytes(bad))


def test_ogg_packets_go_on_over_pages():
    long, other = ogg.LogicalStream(7), ogg.LogicalStream(9)
    packets = [(b"a" * 200_000, 1), (b"", 2), (b"b" * 510, 3), (b"c" * 65_025, 4)]
    mine, theirs = long.pages(packets, first=True, last=True), other.pages([(b"x", 1), (b"y" * 70_000, 2)], first=True, last=True)
    mixed = b"".join(x for pair in itertools.zip_longest(mine, theirs) for x in pair if x)
    found = ogg.demultiplex(mixed)
    assert [p for p, _ in found[7]] == [p for p, _ in packets] and [p for p, _ in found[9]] == [b"x", b"y" * 70_000]
    with pytest.raises(ValueError):
        ogg.demultiplex(b"".join(mine[:1] + mine[2:]))


def test_ogg_checksum_is_the_standard_s():
    crc = 0
    data = bytes(range(200))
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.checksum(data) == crc


def test_ogg_features_of_odd_rows(spark, odd_docs):
    rows = ogg.features_of(ogg.media_of(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert len({(r.media_sha256, r.feature, r.payload_sha256) for r in rows if r.doc_id in (1, 4, 9)}) == 1
    assert {r.payload_bytes for r in rows if r.doc_id in (2, 3)} == {64}


# 6


def test_quality_orders_grades(spark, make_docs):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad, poor = i % 6 == 0, i % 3 == 1
        words = prose(30, i).split() + (["awful", "scum"] if bad else []) + (["$$$", "!!"] if poor else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(bad)))
    docs, rated = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.grade(docs, quality.fit(docs, rated.filter("doc_id < 400"))).collect()}
    held = [(out[i], t, q) for i, q, t in labels if i >= 400]
    assert all(x.keep != bool(t) for x, t, _ in held)
    assert min(x.expected_grade for x, t, q in held if not t and q) > max(x.expected_grade for x, t, _ in held if t)
    assert all(x.p_at_least_1 >= x.p_at_least_2 for x, _, _ in held)


def test_quality_without_labels_and_with_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.grade(odd_docs, quality.fit(odd_docs, none)).collect()
    assert len(rows) == odd_docs.count() and {r.p_at_least_1 for r in rows} == {0.5}


def test_quality_against_a_plain_model(spark, odd_docs, make_docs):
    import re
    from collections import Counter

    rows = [(i, f"{prose(20, i)} {'scum!!' if i % 4 == 0 else 'fine'} {'$$ 12' if i % 3 else ''} {'LOUD' if i % 5 else ''}") for i in range(80)] + [(7, "a second text of seven")]
    labels = spark.createDataFrame([(i, i % 3 and 1, int(i % 4 == 0)) for i in range(60)] + [(5, 1, 0), (5, 0, 1), (1000, 1, 1), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(make_docs(rows), labels)
    assert np.count_nonzero(model.weights) > 5

    def tails(text):
        count = Counter()
        for x in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+", (text or "").encode()):
            low = x.lower()
            h = int(bytesvec.span_hashes(np.frombuffer(low, np.uint8), np.array([0]), np.array([len(low)]))[0]) >> 46
            count[h] += 1
            count[0] += len(x) > 1 and x.isalpha() and x.isascii() and x.isupper()
        z = sum(float(model.weights[k]) * np.log1p(n) for k, n in count.items())
        return [1 / (1 + np.exp(-np.clip(z - t, -40, 40))) for t in model.thresholds]

    docs = odd_docs.unionByName(make_docs(rows))
    want = sorted((r.doc_id or 0, *np.round(tails(r.text), 5)) for r in docs.collect())
    assert sorted((r.doc_id or 0, round(r.p_at_least_1, 5), round(r.p_at_least_2, 5)) for r in quality.grade(docs, model).collect()) == [(d, pytest.approx(a, abs=2e-5), pytest.approx(b, abs=2e-5)) for d, a, b in want]
    assert all(abs(r.expected_grade - r.p_at_least_1 - r.p_at_least_2) < 1e-9 and r.keep == (r.p_at_least_1 >= 0.5) for r in quality.grade(docs, model).collect())
    assert quality.grade(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_quality_fit_is_a_minimum():
    r = np.random.default_rng(3)
    n, grade = 400, r.integers(0, 3, 400)
    row, bucket = np.repeat(np.arange(n), 2), np.stack([grade + 10, r.integers(20, 24, n)], axis=1).ravel()
    noise = r.random(n) < 0.3
    bucket[::2][noise] = r.integers(10, 13, int(noise.sum()))
    model = quality.fit_rows(row, bucket, np.ones(2 * n), np.eye(3)[grade], rounds=800, rate=0.05, penalty=0.0)

    def loss(w, t1, t2):
        z = np.bincount(row, w[bucket], n)
        one, two = 1 / (1 + np.exp(t1 - z)), 1 / (1 + np.exp(t2 - z))
        return -np.log(np.choose(grade, [1 - one, one - two, two])).mean()

    w, (t1, t2) = model.weights.astype(float), model.thresholds
    best = loss(w, t1, t2)
    for k in (10, 11, 12, 20):
        for step in (0.05, -0.05):
            other = w.copy()
            other[k] += step
            assert loss(other, t1, t2) > best - 1e-5
    assert all(loss(w, t1 + a, t2 + b) > best - 1e-5 for a, b in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


# 7


def language_rows(n):
    kinds = {"aa": "abaca gaba daca baga", "bb": "ximo zexo vizo moxe", "cc": "trulp krund sprolk"}
    return [(i, " ".join(random.Random(i).choices(words.split(), k=20)), name) for i, (name, words) in zip(range(n), itertools.cycle(kinds.items()), strict=False)]


def test_language_of_held_out_rows(spark, make_docs):
    rows = language_rows(300)
    docs = make_docs([*rows, (900, None, "aa"), (901, "123 ...", "aa"), (902, "", "bb"), (903, "abaca gaba", None)])
    out = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).collect()}
    assert all(out[i].lang_pred == name for i, _, name in rows)
    assert {out[i].lang_pred for i in (900, 901, 902)} == {"und"} and out[900].rejected and out[900].score == 0
    assert out[903].lang_pred == "aa" and 0 < out[903].score <= 1
    assert langid.accepted(docs, langid.fit(docs)).count() == 301


def test_language_without_training_rows(spark, make_docs, odd_docs):
    docs = make_docs([(1, "some words", None), (2, None, "en")])
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()} == {("und", 0.0)}
    assert langid.identify(make_docs([]), langid.fit(make_docs([]))).collect() == []
    assert langid.identify(odd_docs, langid.fit(odd_docs)).count() == odd_docs.count()


def test_language_against_a_plain_classifier(spark, make_docs):
    from collections import Counter

    rows = [(i, t, n) for i, t, n in language_rows(200)]
    docs = make_docs([*rows, (500, "Qwerty uiop zxcv bnm " * 20, None), (501, "abaca é", None)])
    model = langid.fit(docs)
    assert sorted(set(model.names)) == ["aa", "bb", "cc"] and len(model.names) <= 3 * langid.CENTROIDS

    def vector(text):
        data = b"  " + bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b"  "
        count = Counter()
        for i in range(2, len(data)):
            if data[i] != 32:
                a, b, c = data[i - 1], data[i], data[i + 1]
                for gram in (b | 1 << 30, a << 8 | b | 1 << 29, (a << 8 | b) << 8 | c):
                    count[(gram * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        x = np.zeros(langid.DIMENSIONS)
        for k, n in count.items():
            x[k] = (1 + np.log(n)) * model.idf[k]
        return x / np.linalg.norm(x), sum(count.values()) / 3

    for r in langid.identify(docs.select("doc_id", "text"), model).collect():
        x, letters = vector(r.text)
        cosine = model.centres @ x
        best = int(np.argmax(cosine))
        limit = max(model.limit[best], langid.LEAST_LIMIT * min(1, (langid.SHORT / letters) ** 0.5))
        assert (r.lang_pred, r.rejected) == (model.names[best], 1 - cosine[best] > limit) and r.score == pytest.approx(max(0, cosine[best]), abs=1e-5)
        assert r.rejected == (r.doc_id == 500)


def test_centroids_come_from_a_bounded_sample(spark, make_docs, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    model = langid.fit(make_docs(language_rows(300)))
    assert sorted(set(model.names)) == ["aa", "bb", "cc"]


def test_features_don_t_depend_on_neighbours():
    texts = ["one two", "three", "", "one two"]
    together = np.concatenate([c for _, c in langid.counts(texts)])
    alone = np.concatenate([c for t in texts for _, c in langid.counts([t])])
    assert (together == alone).all()


# 9


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_against_brute_force(spark, make_docs, monkeypatch):
    r = random.Random(7)
    rows = []
    for family in range(6):
        words = prose(120, family).split()
        for _ in range(45):
            own = list(words)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rows += [(2000 + i, rows[5][1].upper()) for i in range(30)] + [(3000, None), (3001, ""), (3002, "one two"), (3003, "ONE  two"), (3004, "two one"), (3005, prose(2000, 70))]
    want = brute_components(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == want
    monkeypatch.setattr(minhash, "BLOCK", 16)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(make_docs(rows)).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd_docs, make_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[4].component_id == by[9].component_id == 1 and not by[4].kept and by[1].kept
    assert by[2].n_shingles == 0 and by[2].kept and by[3].component_id == 3 and by[None].component_id is None
    assert minhash.near_duplicates(make_docs([])).collect() == []


def test_a_drifting_family_is_one(spark, make_docs):
    words = prose(400, 3).split()
    rows = []
    for i in range(700):  # each is close to those near it and far from the ends
        words[i * 7 % 400] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert set(got.values()) == {0}


def test_one_of_each_judges_rows_not_ids(spark, make_docs):
    a, u, v = prose(60, 1), prose(60, 2), prose(60, 3)
    docs = make_docs([(1, a), (2, a), (2, u), (3, f"{u[:40]} {v}"), (4, a), (1, a), (5, None), (5, None), (None, a), (6, "x  y"), (6, "x y"), (6, "x y")])
    out = sorted((r.doc_id or 0, r.text or "") for r in minhash.one_of_each(docs).collect())
    assert out[:-1] == sorted([(0, a), (1, a), (2, u), (3, f"{u[:40]} {v}"), (5, ""), (5, "")]) and out[-1] in [(6, "x  y"), (6, "x y")]
    assert minhash.one_of_each(docs).columns == docs.columns and minhash.one_of_each(docs.limit(0)).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 3), (7, 7), (20, 19), (19, 18), (18, 17), (17, 16)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 5: 1, 10: 10, 11: 10, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_few_edges_are_few_files(spark):
    """The rounds of a small graph don't take a task and a file for each of many shuffle partitions (check_h)."""
    from tessera.llm.components import components

    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = components(spark.createDataFrame([(i, i + 1) for i in range(200) if i % 5], "u long, v long"))
        assert len(out.inputFiles()) <= 6
        assert {(r.node, r.component) for r in out.collect()} == {(n, (n - 1) // 5 * 5 + 1) for n in range(1, 201)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)



# 10


def lm_rows(docs):
    return [(r.doc_id, [*(r.text or "").encode().lower().split(), b" end"], r.held) for r in docs.collect()]


def pair_model(rows):
    """Brute force: P(w | u) from exact pair counts, quantised; by the contract's base and the docstring's formula."""
    from collections import Counter

    c, both = Counter(), Counter()
    for _, own, held in rows:
        if not held:
            c.update(own)
            both.update(zip([b" end", *own], own, strict=False))
    n, v = sum(c.values()), len(c)
    q = {k: 1 if x == 1 else 1.4 * 2 ** (x.bit_length() - 1) for k, x in both.items()}
    s, m = Counter(), Counter()
    for (u, _), x in q.items():
        s[u] += x
        m[u] += 1
    once, twice = (sum(x == i for x in both.values()) for i in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    plain = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    return c, n, v, plain, lambda u, w: (max(q.get((u, w), 0) - d, 0) + d * m[u] * plain(w)) / s[u] if s[u] else plain(w)


def test_language_model_counts_are_exact(spark, odd_docs, monkeypatch):
    docs = odd_docs.filter("doc_id is not null").withColumn("held", odd_docs.doc_id > 8)
    rows = lm_rows(docs)
    c, n, v, plain, _ = pair_model(rows)
    want = sorted((d, len(own), sum(c[w] > 0 for w in own), round(sum(np.log10(plain(w)) for w in own), 4)) for d, own, _ in rows)
    for head in (1 << 20, 4):  # with few words broadcast, the others come from blocks
        monkeypatch.setattr(bloomlm, "HEAD", head)
        model, *parts = bloomlm.fit(docs.filter("not held"))
        assert (model.total, model.distinct) == (n, v) and len(model.keys) <= head
        out = bloomlm.score(docs, model, *parts).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out) == want
        assert all(r.train_tokens == n and r.score <= 0 for r in out)


def test_language_model_against_brute_force_at_any_size(spark, make_docs, monkeypatch):
    docs = make_docs([(i, prose(80, i)) for i in range(40)] + [(100, "one two one two"), (101, "rare pair here"), (102, "here rare"), (106, "nowhere else"), (103, None)]).drop("held").selectExpr("*", "doc_id % 5 = 1 AS held")
    rows = lm_rows(docs)
    *_, chance = pair_model(rows)
    want = {d: sum(np.log10(chance(u, w)) for u, w in zip([b" end", *own], own, strict=False)) for d, own, _ in rows}
    for head, piece, probe, bucket, held in ((1 << 20, 1 << 20, 1 << 22, 1 << 20, 1 << 22), (4, 7, 50, 10, 30)):
        for name, value in (("HEAD", head), ("PIECE", piece), ("PROBE", probe), ("TOKENS_PER_BUCKET", bucket), ("_HELD", held), ("FLUSH", 20 * probe)):
            monkeypatch.setattr(bloomlm, name, value)
        out = {r.doc_id: r.score for r in bloomlm.score(docs, *bloomlm.fit(docs.filter("not held"))).collect()}
        off = sorted(out[d] - want[d] for d in want)  # chance hits, 2**-8 of these lookups or fewer, only add to a score
        assert off[0] > -1e-6 and off[len(off) * 7 // 10] < 1e-6 and off[-1] < 3


def test_probabilities_sum_to_one_and_don_t_depend_on_the_session(spark):
    from tessera.llm.common import documents

    data = "/root/testdata/sf0.001"
    docs = documents(spark, data).selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 AS held")
    model, tail, blocks = bloomlm.fit(docs.filter("not held"))
    files = sorted(tail.inputFiles()), sorted(blocks.inputFiles())
    order = np.argsort(model.counts)
    sums = []
    for u in model.keys[np.concatenate([order[-30:], np.random.default_rng(1).choice(order, 70)])]:
        tokens = np.empty(2 * len(model.keys), np.uint64)
        tokens[0::2], tokens[1::2] = u, model.keys
        sums.append((10 ** bloomlm.chances(model, *files, tokens, np.array([0, len(tokens)]))[1][1::2]).sum())
    assert min(sums) > 0.999 and np.mean(sums) < 1 + 1.4 * bloomlm.EXTRA and np.quantile(sums, 0.9) < 1 + 1.4 * bloomlm.EXTRA
    scores = [{r.doc_id: r.score for r in bloomlm.score(docs, model, tail, blocks).collect()}]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        scores.append({r.doc_id: r.score for r in bloomlm.op10_lm_scoring(spark, data).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(abs(scores[0][d] - scores[1][d]) < 1e-9 * abs(scores[0][d]) for d in scores[0])


def test_filter_has_no_false_negatives_and_few_false_positives():
    r = np.random.default_rng(8)
    keys, level, k = r.integers(0, 1 << 64, 5000, dtype=np.uint64), r.integers(1, 5, 5000), r.integers(8, 20, 5000)
    f = bloomlm.Filter.of(keys, level, k)
    most = np.full(5000, 40)
    found = f.levels(keys, k, most)
    assert (found >= level).all() and (found > level).mean() < 0.01 and (f.levels(keys, k, level) == level).all()
    others = r.integers(0, 1 << 64, 200_000, dtype=np.uint64)
    assert (f.levels(others, np.full(200_000, 8), np.full(200_000, 40)) > 0).mean() < 1.3 / 256
    assert (f.levels(others, np.full(200_000, 16), np.full(200_000, 40)) > 0).mean() < 3e-5


def test_language_model_of_no_rows(spark, make_docs):
    docs = make_docs([(1, "some words")]).drop("held").selectExpr("*", "true AS held")
    row = bloomlm.score(docs, *bloomlm.fit(docs.filter("not held"))).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, row.base_score)
    assert bloomlm.score(docs.limit(0), *bloomlm.fit(docs)).collect() == [] == bloomlm.score(docs.limit(0), *bloomlm.fit(docs.limit(0))).collect()


# bytes


def test_words_and_hashes():
    texts = [b"One two\tTHREE\x0bfour", b"", b"  ", "é É".encode(), b"x" * 1_000_000 + b" y"]
    _, starts, ends, hashes, before = bytesvec.words(texts)
    assert np.diff(before).tolist() == [4, 0, 0, 2, 2]
    alone = np.concatenate([bytesvec.words([t])[3] for t in texts])
    assert (alone == hashes).all() and len(set(hashes.tolist())) == 8
    assert (bytesvec.words([b"three"])[3] == hashes[2]).all()
    assert pa.array([1]).type == pa.int64()

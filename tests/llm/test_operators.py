"""Corpus operators against brute force, with awkward rows, and without any rows."""

import base64
import collections
import fractions
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from flighttone.llm import (
    graph,
    id_files,
    languages,
    licenses,
    lines,
    packing,
    phrases,
    piece_model,
    queries,
    recipes,
    simhash,
    texts,
    urls,
)
from tests.conftest import SMALL

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", " ", "a  b", "a \n b", "it's, don't  x", "  x y", "x  y", "é é　 z.\n\nA", "a\x1c b\x85 c",
    "<|endoftext|> x", "é ́x", "ΑΣ. ΑΣ b", "\t\ta,b ..  c!?", "x\r\ny", "日本 語。 x", "a" * 3000, "12 34a5 .6",
    "▁x ▁", "\x00\x01", "\xa0a", "👍🏽 x", "Naïve\nÀ la carte",
]
#: Columns whose names operators use inside.
EXTRA = "lang string, _row long, fp long, recipe string, key string, r1 string, n int, word string, context string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", "y", "z", 3, "w", "c") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    words = "the cat sat on a mat and looked at the dog".split()
    long = " ".join(words[(i * i) % 11] + str(i % 97) * (i % 3 == 0) for i in range(40_000))
    rows = [*enumerate(ODD), (100, None), (101, None), (102, long), (103, long.upper()), (103, long), (104, "Same"), (104, "Same")]
    rows += [(None, "no id"), (105, "line\n" * 5 + " LINE \t\nother")]
    rows += [(200 + i, f"text {i}\n shared Line\nend {i % 3}") for i in range(14)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return table(spark, awkward).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def duck(sql, rows, tables=None):
    con = duckdb.connect()
    for name, (columns, held) in (tables or {"documents": ("doc_id bigint, text varchar", rows)}).items():
        con.execute(f"create table {name}({columns})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(columns.split(',')))})", held)
    return con.execute(sql).fetchall()


def tokenizer(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_are_whole_texts():
    import pyarrow as pa

    pieces = texts.Pieces(pa.chunked_array([pa.array(ODD)]))
    joined = [pieces.distinct[i] for i in pieces.which]
    assert ["".join(joined[a:b]) for a, b in zip(pieces.first, pieces.first[1:])] == ODD


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_library(path, awkward):
    import pyarrow as pa

    held = [t or "" for _, t in awkward]
    ids, bounds = texts.tokenizer_encoder(path)(pa.chunked_array([pa.array(held)]))
    expected = tokenizer(path)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [expected(t) for t in held]


def test_blocks_are_bounded():
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(["x" * 1000] * 100)})
    found = list(texts.blocks([batch, batch], 20_000))
    assert sum(b.num_rows for b in found) == 200 and max(b.num_rows for b in found) < 40


def check_packed(rows, expected):
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for found in seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= found[0].context and (found[0].sequence_id < 0 or at == found[0].context)
    left = collections.Counter(expected)
    for doc_id, found in by.items():
        pieces = collections.Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
        want = [ids for (key, ids), n in left.items() if key == doc_id for _ in range(n)]
        assert sum(r.length for r in found) == sum(map(len, want))
        for start, length, said, size in pieces:
            assert any(len(ids) == size and crc(ids[start : start + length]) == said for ids in want)
    assert set(by) == {k for k, _ in expected}


@pytest.mark.parametrize("tiers", [packing.TIERS, (64, 32, 16)])
def test_pack(docs, awkward, tiers):
    encode = tokenizer(BYTE_BPE)
    rows = packing.pack(docs, BYTE_BPE, tiers=tiers).collect()
    check_packed(rows, [(i, (*encode(t), 1)) for i, t in awkward])
    padded = {r.sequence_id for r in rows if r.sequence_id < 0}
    assert len(padded) <= 1
    groups = collections.Counter()
    for key, step, context in {(r.sequence_id, r.step_group, r.context) for r in rows if r.sequence_id >= 0}:
        groups[step, context] += context
    assert max(groups.values(), default=0) <= packing.STEP_TOKENS
    assert len({s for s, _ in groups}) == len(groups)


def test_pack_all_sizes():
    """Documents of every combination of sizes, among them those of the tiers, in one block and in one each."""
    for sizes in (s for n in (1, 2, 3) for s in itertools.product(range(1, 10), repeat=n)):
        ids = [np.arange(n, dtype=np.uint32) + 100 * i for i, n in enumerate(sizes)]
        for step in (1, len(sizes)):
            packer, rows = packing._Packer((8, 4, 2, 1), 16, 0), []
            for at in range(0, len(sizes), step):
                part = ids[at : at + step]
                keys = np.empty(len(part), object)
                keys[:] = range(at, at + len(part))
                rows += packer.add(keys, np.concatenate(part), np.cumsum([0, *map(len, part)]))
            rows += packer.last()
            pieces = sorted((r[0], r[1], r[2], r[3]) for r in rows)
            for i, n in enumerate(sizes):
                own = [p for p in pieces if p[0] == i]
                assert [p[1] for p in own] == np.cumsum([0, *(p[2] for p in own)])[:-1].tolist()
                assert sum(p[2] for p in own) == n
                assert all(p[3] == crc(ids[i][p[1] : p[1] + p[2]].tolist()) for p in own)
            windows = collections.defaultdict(list)
            for r in rows:
                windows[r[5]].append((r[6], r[2], r[7]))
            for found in windows.values():
                found.sort()
                assert [f[0] for f in found] == np.cumsum([0, *(f[1] for f in found)])[:-1].tolist()
                assert sum(f[1] for f in found) == found[0][2]


def test_pack_nothing(nothing):
    assert packing.pack(nothing, BYTE_BPE).count() == 0


def test_id_files(spark, docs, awkward, tmp_path):
    encode = tokenizer(WORD_BPE)
    files = id_files.write(docs, f"file://{tmp_path}", WORD_BPE, end_id=2)
    rows = id_files.read(files, with_ids=True).orderBy("start").collect()
    expected = collections.Counter((i, tuple([*encode(t), 2])) for i, t in awkward)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == expected
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert not list(tmp_path.glob("_attempt*"))
    path = files.orderBy("file").first().path
    one = id_files.IdFile(path)
    assert [one.ids(i).tolist() for i in range(len(one))] == [r.ids for r in rows[: len(one)]]


def test_id_file_refuses_another_dictionary(spark, docs, tmp_path):
    files = id_files.write(docs, f"file://{tmp_path}", WORD_BPE, end_id=2)
    next(tmp_path.glob("*.dictionary")).write_bytes(b"other")
    with pytest.raises(ValueError, match="another dictionary"):
        id_files.IdFile(files.first().path)


@pytest.mark.parametrize("key", [None, 7])
def test_id_files_of_one_id(spark, key, tmp_path):
    """Rows without an id, with the same one, and equal rows are spread over files."""
    encode = tokenizer(WORD_BPE)
    rows = [(key, "the same text")] * 150 + [(key, f"text {i} of {i % 7}") for i in range(150)]
    files = id_files.write(table(spark, rows), f"file://{tmp_path}", WORD_BPE, end_id=2)
    assert files.count() > 2 and max(r.n_docs for r in files.collect()) < 150
    found = id_files.read(files, with_ids=True).orderBy("start").collect()
    assert collections.Counter(tuple(r.ids) for r in found) == collections.Counter((*encode(t), 2) for _, t in rows)
    assert [r.start for r in found] == list(np.cumsum([0] + [r.n_tokens for r in found])[:-1])


def test_id_files_refuse_local_disks():
    class Cluster:
        master = "spark://host:7077"

    class Docs:
        sparkSession = type("S", (), {"sparkContext": Cluster})  # noqa: N815

    with pytest.raises(ValueError, match="names no file system"):
        id_files.write(Docs, "/data/ids", WORD_BPE, end_id=2)


def test_shared_folder_is_qualified(spark):
    assert re.match("[a-z0-9]+:/", id_files.shared_folder(spark, "x"))


def test_id_files_of_nothing(nothing, tmp_path):
    files = id_files.write(nothing, f"file://{tmp_path}", WORD_BPE, end_id=2)
    assert files.count() == 0 and id_files.read(files).count() == 0


def test_licenses_as_in_sql(spark, awkward):
    notice = licenses.NOTICES["gpl-header"]
    changed = notice.replace("redistribute", "copy")
    rows = [r for r in dict(awkward).items() if r[0] is not None]
    rows += [(900, "Zz " * 50 + notice + " zz" * 70), (901, changed), (902, notice[: len(notice) // 2])]
    rows += [(903, "x " * 33 + licenses.NOTICES["mit"] + "\nReleased   under the MIT license!")]
    rows += [(1000 + i, "w " * i + licenses.NOTICES["bsd"] + " v" * i) for i in range(40)]
    found = licenses.scan(table(spark, rows)).collect()
    assert sorted(map(tuple, found)) == sorted(duck(licenses.sql(), rows))
    assert {r.license_id for r in found if r.doc_id == 900} == {"gpl-header"}


def test_licenses_edges(spark, docs, nothing):
    assert licenses.scan(nothing).count() == 0
    assert licenses.scan(docs, {}).count() == 0
    assert licenses.scan(docs).count() == 0
    assert licenses.bands(0.5, 1e-6) == 20
    with pytest.raises(ValueError):
        licenses.Templates({"short": "too few words"}, 0.8, 1e-6)


def test_piece_model(docs, awkward):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = piece_model.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = collections.Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in awkward)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in rows) == expected
    back = collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in awkward)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in rows) == back
    for r in rows:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_piece_model_nothing(nothing):
    assert piece_model.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_minimal_hash(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    place = lines.MinimalHash.build(h[0], h[1])
    assert sorted(place(h[0], h[1]).tolist()) == list(range(n))


def brute_lines(rows, least):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(
        {c: c + 32 for c in range(65, 91)}
    )
    met = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if not key(x) or met[key(x)] < least]
        yield i, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("least", [2, 10])
def test_lines(docs, awkward, least):
    found = lines.drop_common_lines(docs, least, with_text=True).collect()
    assert collections.Counter(r[:4] for r in map(tuple, found)) == collections.Counter(brute_lines(awkward, least))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_lines_as_in_sql_where_ids_repeat(spark, awkward):
    rows = [*awkward, *[(7, "Often\nown")] * 3, *[(None, f"often \n{i}") for i in range(8)], (8, "x\n OFTEN")]
    found = lines.drop_common_lines(table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, duck(queries.SQL["op5_lines"], rows)))
    assert sum(r.n_dropped for r in found if r.doc_id in (None, 7, 8)) >= 12


def test_frequent_lines_have_their_own_shard(spark, monkeypatch):
    monkeypatch.setattr(lines, "GROUP_LINES", 4)
    monkeypatch.setattr(lines, "FREQUENT", 60)
    built = []
    build = lines.build_index
    monkeypatch.setattr(lines, "build_index", lambda *a: built.append(build(*a)) or built[-1])
    rows = [(i, "\n".join(["Hot ", f"pair {i // 2}", f"alone {i}", "hot"] + ["", "warm"] * (i < 12))) for i in range(40)]
    found = lines.drop_common_lines(table(spark, rows), 10, with_text=True).collect()
    assert collections.Counter(r[:4] for r in map(tuple, found)) == collections.Counter(brute_lines(rows, 10))
    assert lines.OWN_SHARD in {r.shard for r in built[0].collect()} and sum(r.n_dropped for r in found) == 92


def test_lines_edges(spark, docs, nothing):
    assert lines.drop_common_lines(nothing).count() == 0
    unique = table(spark, [(1, "a"), (2, "b")])
    assert [r.n_dropped for r in lines.drop_common_lines(unique).collect()] == [0, 0]
    with pytest.raises(ValueError):
        lines.drop_common_lines(docs, 1)


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(simhash._LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= near):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash(docs, awkward):
    rows = simhash.near_copies(docs).collect()
    ordered = sorted(awkward, key=lambda r: math.inf if r[0] is None else r[0])
    prints = [brute_simhash(t) for _, t in ordered]
    roots = brute_roots(prints, simhash.THRESHOLD)
    expected = collections.Counter(
        (i, f"{p:016x}", ordered[r][0]) for (i, _), p, r in zip(ordered, prints, roots)
    )
    assert collections.Counter(map(tuple, rows)) == expected


def test_anchors_lose_no_link(spark):
    rng = np.random.default_rng(5)
    values = [0, (1 << 64) - 1]
    for x in rng.integers(0, 1 << 63, 120, dtype=np.uint64).tolist() + [3]:
        values.append(x * 2)
        for bits in (1, 2, 2, 3):
            values.append(x * 2 ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    values = sorted(set(values))
    frame = spark.createDataFrame([(v - (1 << 64) * (v >> 63),) for v in values], "fp long")
    found = {r.u % (1 << 64): r.v % (1 << 64) for r in graph.components(simhash.links(frame)).collect()}
    mine = collections.defaultdict(set)
    theirs = collections.defaultdict(set)
    for v, root in zip(values, brute_roots(values, 2)):
        mine[found.get(v, v)].add(v)
        theirs[root].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_large_group_at_one_anchor(monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 50)
    fps = np.arange(40, dtype=np.uint64) << np.uint64(50)
    key = np.concatenate([np.zeros(20, np.int64), np.ones(20, np.int64)])
    links = [(int(a), int(b)) for u, v in simhash._compare(key, fps, 2) for a, b in zip(u, v)]
    near = {(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 2}
    assert links and all(len(links) < 4 * len(near) for _ in [0])
    reach = {f: f for f in fps.tolist()}
    for _ in range(40):
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert set(reach.values()) == {0}


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (7, 300)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(1, 31)}, 300: 0, 101: 100}


def test_anchors_stay_whole():
    import pyarrow as pa

    key = np.repeat(np.arange(40), [1, 90] * 20) << 1
    batches = [pa.record_batch({"key": key[i : i + 7], "fp": np.arange(len(key))[i : i + 7]}) for i in range(0, len(key), 7)]
    for rows in (1, 50, 10_000):
        met = list(simhash._whole_anchors(batches, rows))
        assert np.concatenate([f for _, f in met]).tolist() == list(range(len(key)))
        assert sum(len(np.unique(k)) for k, _ in met) == 40
    assert not list(simhash._whole_anchors([batches[0].slice(0, 0)]))


def test_settings_of_the_session_stay(spark, docs):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "7")
    simhash.near_copies(docs).count()
    assert spark.conf.get(rows) == "7"
    spark.conf.set(rows, before)


def test_simhash_nothing(nothing):
    assert simhash.near_copies(nothing).count() == 0


PAGES = [
    (1, "https://blog.catdog.Example.org/en/12?x", "<p>cat dog cat dog</p>"),
    (2, "http://www.cheap-pills.example.com/x", "the cat"),
    (3, "http://cheapdog.example.net/cheap/DOG", None),
    (4, "https://example.org/es/1#t", "dog"),
    (5, "http://a.b.example.org", "dog"),
    (6, None, "dog"),
    (7, "no scheme", "dog"),
    (8, "x://EXAMPLE.com/de/", "dog<script>cat</script>"),
    (9, "http://com/fr/", "<b>dog</b>"),
    (9, "http://com/fr/", "<b>dog</b>"),
    (None, "http://notexample.org.net/es/", ""),
    (10, "http://" + "dogcat" * 500 + ".net/" + "q" * 3000, "dog cat"),
    (11, "://?q#", "dog"),
]


def brute_urls(rows):
    rest = {}
    counts = collections.Counter()
    for i, (_, url, html) in enumerate(rows):
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", after)[0]
        rest[i] = host.translate({c: c + 32 for c in range(65, 91)}), re.match("[^?#]*", after[len(host) :])[0]
        bare = re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", html or "").lower()
        counts.update(w for w in re.split(r"[\W\d_]+", bare) if re.fullmatch("[a-z]{1,24}", w))
    counts.update({t: urls.TERM_COUNT for t in urls.TERMS})
    total = sum(counts.values())
    words = {}
    for i, (host, path) in rest.items():
        names = re.findall("[a-z]+", host) + re.findall("[a-z]+", path.lower())
        words[i] = [w for n in names for w in urls.viterbi(n, counts, total)]
    bad = {i for i, found in words.items() if set(found) & set(urls.TERMS)}
    seen = {True: collections.Counter(), False: collections.Counter()}
    for i, found in words.items():
        seen[i in bad].update(found)
    size = len({w for found in words.values() for w in found})
    prior = math.log(len(bad) + 1) - math.log(len(rows) - len(bad) + 1)
    part = lambda w, b: math.log((seen[b][w] + 1) / (sum(seen[b].values()) + size))
    for i, (host, path) in rest.items():
        score = prior + sum(part(w, True) - part(w, False) for w in words[i])
        fits = [
            (len(h + p), h + p, v) for v, h, p in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule = max(fits, default=(0, None, "block" if score > 0 else "allow"))
        yield rows[i][0], host, path, rule[1], rule[2], round(score, 6) if words[i] else None


def test_urls(spark):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, names string, n int")
    found = [(*r[:5], None if r[5] is None else round(r[5], 6)) for r in map(tuple, urls.judge(frame).collect())]
    assert sorted(found, key=str) == sorted(brute_urls(PAGES), key=str)
    assert urls.judge(frame.limit(0)).count() == 0


def test_terms_anywhere_in_long_names(spark):
    """A verdict does not depend on where in a long run of letters a term stands."""
    fill = "the cat and dog looked at a mat in this house on that day".replace(" ", "")
    held = [(f"http://a{i}.net/{fill[:i]}casino{fill * 3}", "casino the cat and dog looked at a mat in this house on that day") for i in range(len(fill))]
    held += [(f"http://b{i}.net/{fill[i:]}{fill * 3}", "the cat and dog") for i in range(20)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(held)], "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in urls.judge(frame).collect()}
    assert [found[i] for i in range(len(held))] == ["block"] * len(fill) + ["allow"] * 20


def test_hot_names_and_words(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLED", 1)
    kept, met = urls.join_unique, []
    monkeypatch.setattr(urls, "join_unique", lambda *a: met.append(a[2]) or kept(*a, hot_rows=2))
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, names string, n int")
    found = [(*r[:5], None if r[5] is None else round(r[5], 6)) for r in map(tuple, urls.judge(frame).collect())]
    assert sorted(found, key=str) == sorted(brute_urls(PAGES), key=str) and met == [["word"], ["name"], ["word"]]


def test_urls_learn_unwanted_words(spark):
    rows = queries.op7_urls(spark, "/root/testdata/sf0.01").filter("rule is null").collect()
    unwanted = ("pills", "casino", "adult", "spam", "ads", "bets")
    assert all((r.verdict == "block") == any(u in r.host for u in unwanted) for r in rows)


def test_languages(spark, docs):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = languages.learn(known.filter(~languages.held_out()), PIECES)
    found = languages.languages(known, PIECES)
    assert languages.accuracy(known, found) > 0.95
    rows = languages.classify(docs, model, ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages and 0 <= r.score <= 1
    assert languages.classify(docs, model, ["doc_id"]).count() == docs.count()


def test_every_segmentation_counts(spark):
    known = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = languages.learn(known, PIECES)
    place = languages.vocabulary(PIECES).index

    def total(word, row):
        if not word:
            return 1.0
        out = sum(row[place[word[:k]]] * total(word[k:], row) for k in range(1, len(word) + 1) if word[:k] in place)
        return out if word[0] in place else out + row.min() * languages.UNKNOWN * total(word[1:], row)

    words = ["▁the", "▁strasse", "▁ßtz", "▁日", "été"]
    expected = np.log([[total(w, row) for row in model.pieces] for w in words])
    assert np.allclose(model.word_scores(words), expected)
    assert np.allclose(model.word_scores(words * languages.TOGETHER), np.concatenate([expected] * languages.TOGETHER))
    assert languages.words_of("x" * 70 + " Ab1c") == ["▁" + "x" * 70, "▁ab", "▁c"]

    def whole(word, row):
        """From the end, in whole numbers of great size, so without rounding at any length."""
        at = [fractions.Fraction(1)]
        exact = [fractions.Fraction(p) for p in row]
        unknown = min(exact) * fractions.Fraction(languages.UNKNOWN)
        for end in range(1, len(word) + 1):
            ways = [at[b] * exact[place[word[b:end]]] for b in range(max(0, end - 20), end) if word[b:end] in place]
            if word[end - 1 : end] not in place:
                ways.append(at[end - 1] * unknown)
            at.append(sum(ways))
        return math.log(at[-1].numerator) - math.log(at[-1].denominator)

    long = ["▁donaudampfschifffahrtselektrizitätenhauptbetriebswerk", "▁" + "人人生而自由在尊严和权利上一律平等" * 6, "▁" + "x" * 150]
    expected = [[whole(w, row) for row in model.pieces] for w in long]
    assert np.allclose(model.word_scores(long), expected)
    assert np.allclose(model.word_scores([w for w in long for _ in range(9)])[::9], expected)


def test_languages_without_labels(docs, nothing):
    assert languages.languages(nothing, PIECES).count() == 0
    model = languages.learn(nothing, PIECES)
    assert {r.lang_pred for r in languages.classify(docs, model, ["doc_id"]).collect()} == {"und"}


def brute_phrases(text):
    found, begin, data = set(), 0, text.encode()
    for end in range(1, len(data) + 1):
        if data[begin:end] not in found:
            found.add(data[begin:end])
            begin = end
    if begin < len(data):
        found.add(data[begin:] + b"\0end")
    return sorted({xxhash.xxh32_intdigest(p) for p in found})[: phrases.SIZE]


@pytest.mark.parametrize("rows", [2, 100_000])
def test_phrases(docs, awkward, rows):
    found = phrases.fingerprints(docs, range_rows=rows).collect()
    order = sorted(((-1 if i is None else i), t or "") for i, t in awkward)
    expected = collections.Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        one, two, three = map(brute_phrases, (text, edited, after))
        expected[(
            None if i < 0 else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases._hex(one),
            phrases._hex(two), phrases.likeness(one, two), phrases.likeness(one, three),
        )] += 1
    assert collections.Counter(map(tuple, found)) == expected


@pytest.mark.parametrize("key", [None, 7])
def test_phrases_of_one_id(spark, key):
    """Rows of one id and equal rows are dealt to many ranges, and each is followed by the next."""
    rows = [(key, "the same text, again and again")] * 300 + [(key, f"{'x' * 40} {i}") for i in range(150)] + [(9, "the end")]
    held = table(spark, rows).repartition(5)
    ranges, _ = phrases._plan(texts.slim(held, "doc_id"), 20)
    assert len(ranges.parts) == 1 and ranges.parts.popitem()[1] >= 7 and len(ranges.ends) > 6
    found = phrases.fingerprints(held, range_rows=20).collect()
    assert len(found) == len(rows)
    same = sum(r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"the same text, again anthe sam").hexdigest() for r in found)
    assert same == 299
    fit = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()
    said = collections.Counter(r.edited_sha256 for r in found)
    assert said[fit("the end", rows[0][1])] == 1
    # Of the others every one but the last is followed by one of them, all of which begin alike.
    assert sum(said[x] for x in {fit(t, "x" * 40) for _, t in rows[300:450]}) == 149


def test_hub_of_many_links(spark, monkeypatch):
    kept, met = graph.join_unique, []
    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    monkeypatch.setattr(graph, "join_unique", lambda *a: met.append(1) or kept(*a, hot_rows=10))
    links = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(59, 60), (60, 61), (200, 201)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert met and found == {**{i: 0 for i in range(1, 62)}, **{i: 100 for i in range(101, 130)}, 201: 200}


def test_phrases_edges(spark, nothing):
    assert phrases.fingerprints(nothing).count() == 0
    alone = phrases.fingerprints(table(spark, [(1, "abcdefgh")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert phrases.likeness([], []) == 1.0 and phrases.likeness([1, 2], [2, 3]) == 1 / 3


def test_exact_copies(docs, awkward):
    rows = recipes.exact_copies(docs).collect()
    lower = {c: c + 32 for c in range(65, 91)}
    groups = collections.defaultdict(list)
    for i, t in awkward:
        groups[(t or "").translate(lower)].append(i)
    assert len(rows) == len(awkward)
    by_text = collections.defaultdict(list)
    for r in rows:
        by_text[r.text_sha256].append(r)
    for text, ids in groups.items():
        found = by_text[hashlib.sha256(text.encode()).hexdigest()]
        last = max(ids, key=lambda i: -1 if i is None else i)
        assert collections.Counter(r.doc_id for r in found) == collections.Counter(ids)
        assert {(r.keep_id, r.group_size) for r in found} == {(last, len(ids))}
        assert [r.doc_id for r in found if r.kept] == [last]


def test_exact_copies_as_in_sql(spark, awkward):
    rows = list({i: (i, t) for i, t in awkward if i is not None}.values())
    found = recipes.exact_copies(table(spark, rows)).drop("n_chunks").collect()
    assert sorted(map(tuple, found)) == sorted(duck(queries.SQL["op10_exact_copies"], rows))


def test_chunks_of_many_blocks_are_sent_once(spark, monkeypatch):
    shared = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, f"{shared}\n{i} " * 3) for i in range(60)]
    held = table(spark, rows).coalesce(1)
    whole = {tuple(r) for r in recipes.chunks(held, 0).collect()}
    monkeypatch.setattr(recipes, "BLOCK", 100_000)
    for size in (recipes.KEPT, 0):
        monkeypatch.setattr(recipes, "KEPT", size)
        met = [tuple(r) for r in recipes.chunks(held, 0).collect()]
        assert set(met) == whole and (not size or len(met) < 1.2 * len(whole))


def test_chunks_follow_content(nothing):
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8)
    ends = lambda raw: recipes.chunk_ends(recipes.cut_points(raw).tolist(), 0, len(raw))
    whole = ends(data)
    sizes = np.diff([0, *whole])
    assert sizes.max() <= recipes.MOST and sizes[:-1].min() >= recipes.LEAST and whole[-1] == len(data)
    moved = ends(np.concatenate([np.zeros(777, np.uint8), data]))
    assert len(set(whole) & {e - 777 for e in moved}) > 0.8 * len(whole)
    assert recipes.chunk_ends([], 5, 5) == []
    assert recipes.exact_copies(nothing).count() == 0


def test_languages_of_unknown_letters_at_any_size(spark):
    """Long runs of unknown letters neither underflow nor spread to other texts."""
    place = languages.vocabulary(PIECES).index
    counts = np.full((2, len(place)), 0.5)
    counts[0, place["▁the"]], counts[1, place["▁der"]] = 1e12, 2e12
    model = languages.LanguageModel(PIECES, ("a", "b"), counts / counts.sum(axis=1, keepdims=True), np.array([0.5, 0.5]))
    rare = "".join(p for p in place if len(p) == 1)[:32]
    texts = [(1, "der der der"), (2, "ሀ" * 64), (3, "the the the"), (4, rare), (5, "der"), (6, "")]
    assert np.isfinite(model.word_scores(languages.words_of(texts[1][1] + " " + rare))).all()
    held = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in languages.classify(held, model, ["doc_id"]).collect()}
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i in (1, 3, 5, 6)] == ["b", "a", "b", "und"]

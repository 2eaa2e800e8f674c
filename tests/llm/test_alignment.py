"""Alignment of two tokenizers, against the libraries on whole texts and plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarnflow.llm import alignment
from tarnflow.llm.alignment import align_tokenizers, read
from tests.llm.helpers import DOCS, awkward, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown}
    byte |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def spell_a(i):
        return bytes(byte[c] for c in a.id_to_token(i))

    def spell_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    return a, b, spell_a, spell_b


def groups_of(text, tools):
    """Groups of a text: pairs of lists of ids."""
    a, b, spell_a, spell_b = tools
    if not text:
        return []
    want = (" " + text).encode()
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    sa, sb = [spell_a(i) for i in ia], [spell_b(i) for i in ib]
    if b"".join(sa) != want or b"".join(sb) != want:
        return []
    ends_a, ends_b = np.cumsum([len(s) for s in sa]).tolist(), np.cumsum([len(s) for s in sb]).tolist()
    out, x, y = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
        out.append((ia[x:p], ib[y:q]))
        x, y = p, q
    return out


def plain(texts, tools):
    """All rows by loops over the texts."""
    groups = [groups_of(t, tools) for t in texts]
    linked = [Counter((i, j) for g, h in own for i in g for j in h) for own in groups]
    counts = Counter(p for own in linked for p in own)
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for own, links in zip(groups, linked, strict=True):
        printed = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in own)
        out.append((
            sum(len(g) for g, _ in own), sum(len(h) for _, h in own), len(own), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), printed,
        ))
    return out


def rows_of(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted(((r["doc_id"], *(r[c] for c in names)) for r in df.collect()), key=str)


PARTS = [" ", "  ", "\n", "\r\n", ";\r", "\t", " \n ", " ", "　", "  ", "’ ", " ", "\u0085 ", "\x1c ", "\x00", "\x7f ", "the", "Hello", "don't", "naïve", "日本語", "🙂",
         "é", "=====", "12345", "<|endoftext|>", "</s>", "<0x41>", "ا ب", "'s", " 's", "--", "…", "x"]


def fuzz(n, seed, marks=0.05):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 14))) + ("▁" if r.random() < marks else "") for _ in range(n)]


def test_pieces_give_the_ids_of_whole_texts(tools):
    """Cut where it cuts, a text has the libraries' tokens; and the bitsets' groups are those of plain loops."""
    texts = fuzz(4000, 1)
    found = read([t.encode() for t in texts], A, B)
    assert all(side.cuts_before_spaces for side in alignment._SIDES.values())
    place, counts, printed = found.place, found.counts, found.pieces.printed()
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        got = ";".join(printed[i].as_py() for i in place[at : at + n].tolist())
        at += n
        want = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups_of(text, tools))
        assert got == want, repr(text)


def test_merging_by_rank_gives_the_files_ids(tools):
    side = alignment.ByteLevel(A)
    assert side.ranked is not None
    r = random.Random(5)
    ranges = [(0, 0x250), (0x300, 0x370), (0x370, 0x500), (0x600, 0x700), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x4F00), (0x1F600, 0x1F640)]
    letters = [chr(c) for a, b in ranges for c in range(a, b)]
    texts = ["".join(r.choice(letters[:128] if r.random() < 0.7 else letters) for _ in range(r.randrange(1, 25))) for _ in range(20_000)]
    texts += ["".join(r.choice("aeinrst") for _ in range(r.randrange(1, 40))) for _ in range(5000)]
    assert [side.encode(" " + t) for t in texts] == [x.ids for x in tools[0].encode_batch(texts, add_special_tokens=False)]


def test_alignment_equals_plain_loops(spark, tools):
    texts = [*fuzz(150, 2), *fuzz(40, 2), None, "", " ", "the  end ", "=" * 5000, "aé" * 700]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    want = sorted(((i, *row) for i, row in enumerate(plain(texts, tools))), key=str)
    assert rows_of(align_tokenizers(docs, A, B)) == want


def test_blocks_of_counts_give_the_same_rows(spark, tools, monkeypatch):
    texts = [*fuzz(120, 3), None, "", "the the the"]
    docs = spark.createDataFrame([(i % 100, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(4)
    monkeypatch.setattr(alignment, "SENT_PAIRS", 5)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 60)
    want = sorted(((i % 100, *row) for i, row in enumerate(plain(texts, tools))), key=str)
    assert rows_of(align_tokenizers(docs, A, B)) == want


def test_pieces_one_by_one_and_together(monkeypatch):
    texts = [t.encode() for t in fuzz(300, 4)]
    want = read(texts, A, B).numbers()
    monkeypatch.setattr(alignment.ByteLevel, "handed", 40)
    monkeypatch.setattr(alignment.Pieces, "handed", 30)
    assert read(texts, A, B).numbers() == want
    monkeypatch.setattr(alignment, "_may_join", lambda data, sizes: np.zeros(len(sizes), bool))
    assert read(texts, A, B).numbers() == want


def test_alignment_of_awkward_rows(spark, tools):
    docs = awkward(spark)
    rows = docs.collect()
    want = sorted(((r["doc_id"], *row) for r, row in zip(rows, plain([r["text"] for r in rows], tools), strict=True)), key=str)
    assert rows_of(align_tokenizers(docs, A, B)) == want
    assert align_tokenizers(empty(spark), A, B).count() == 0
    clash = spark.createDataFrame([(1, "a b", 2, "c")], "n_a long, text string, row long, groups string")
    assert align_tokenizers(clash, A, B, key="n_a").first()["doc_id"] == 1

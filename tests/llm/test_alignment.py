"""Alignment against a brute-force version over all token pairs, by the file's own library on side A."""

from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from quillstone.llm import alignment as A

from .data import SF, by_id, docs

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "n_mutual", "count_sum")


def brute(texts):
    """Values of COLUMNS by place."""
    ta, tb = Tokenizer.from_file(A.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=A.PIECES)
    ta.encode_special_tokens = True
    letters = A.byte_letters()
    entry = {i: bytes(letters[c] for c in w) for w, i in ta.get_vocab().items() if i != 50256}
    found = []
    for t in texts:
        a = ta.encode(" " + (t or ""), add_special_tokens=False).ids
        b = tb.encode(t or "")
        bytes_b = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tb.id_to_piece(i)]]
        want = (" " + (t or "")).encode()
        if not t or b"".join(entry[i] for i in a) != want or b"".join(bytes_b) != want:
            found.append(None)
            continue
        side = lambda words: [(sum(map(len, words[:i])), sum(map(len, words[: i + 1]))) for i in range(len(words))]
        sa, sb = side([entry[i] for i in a]), side(bytes_b)
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        groups, done = [], 0
        for end in sorted({y for _, y in sa} & {y for _, y in sb}):
            own = lambda ids, spans: ",".join(str(i) for i, s in zip(ids, spans) if done < s[1] <= end)  # noqa: B023, E731
            groups.append(f"{own(a, sa)}|{own(b, sb)}")
            done = end
        found.append((a, b, links, groups))
    count = Counter(p for f in found if f for p in set(f[2]))
    most_a, most_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
    for f in found:
        if not f:
            yield (0, 0, 0, 0, "", 0, 0, 0)
            continue
        a, b, links, groups = f
        best = [(x, y) for x, y in links if count[x, y] == most_a[x]]
        yield len(a), len(b), len(groups), len(links), ";".join(groups), len(best), sum(count[p] == most_b[p[1]] for p in best), sum(count[p] for p in links)


TEXTS = [
    None, "", " ", "   \n\t x", "the cat sat on the mat.", "the cat sat on the mat.", "Straße über naïve façade ñandú", "日本語のテキスト 中文", "a▁b", "<s> </s> <unk> <0x0A> <|endoftext|>",
    "x" * 3000, "👩‍👩‍👧 emoji\u200d", "nul\x00 and \x01\x02", "don't we'll I'm", "1234567890 12,345.67", "\ufeffbom\r\nline  two   three ", "ﬁ ligature ½ Ⅷ",
]


def test_alignment_equals_brute_force(spark):
    got = by_id(A.align(docs(spark, TEXTS)))
    for i, want in enumerate(brute(TEXTS)):
        assert tuple(got[i][c] for c in COLUMNS) == want, TEXTS[i]
    assert got[0].groups_sha256 == "" and len(got[4].groups_sha256) == 64


def test_every_pair_shuffled_or_broadcast(spark):
    texts = ["the cat", "the dog", "a cat and the dog"] * 20
    runs = [sorted(map(tuple, A.align(docs(spark, texts), hot_pairs=n).collect())) for n in (1, 10, 1_000_000)]
    assert runs[0] == runs[1] == runs[2]
    assert [r[1:6] for r in runs[0]] == [w[:5] for w in list(brute(texts))]


def test_small_table_whole(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 2500")
    rows = t.collect()
    got = by_id(A.align(t))
    for r, want in zip(rows, brute([r.text for r in rows])):
        assert tuple(got[r.doc_id][c] for c in COLUMNS) == want


def test_ids_and_empty_table(spark):
    rows = A.align(docs(spark, ["one two", "one two", None], ids=[None, 2**60 + 1, 2**60 + 1])).collect()
    assert sorted((r.doc_id or 0, r.n_a) for r in rows) == [(0, 2), (2**60 + 1, 0), (2**60 + 1, 2)]
    assert A.align(docs(spark, [])).count() == 0


def test_merge():
    a, b, closed = A.merge(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2)] and closed.tolist() == [5, 6]

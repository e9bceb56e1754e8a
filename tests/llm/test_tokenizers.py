import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from bizlens.llm import bpe, token_counts

ODD = "aàáé ńß漢字ΣςİǅЖжʼ'’sdtrevml \n\t\x1c\x85\u00a0\u2003\u200b\u3000!?#$123٣½é🙂👩\u200d👧\ufeffABCthein"


def _texts():
    rng = random.Random(11)
    mixed = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(1500)]
    plain = ["".join(rng.choice("abeinthrso") for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    edges = ["", "x<|endoftext|> y", "<|startoftext|>a<|endoftext|>", "a  b", "a\n\nb", " a", "a ", "a" * 500, "the" * 60, "it's I'LL 'd"]
    return mixed + plain + edges


def test_counts_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    texts = _texts()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.count(t) == len(e.ids), t


def test_ids_and_decoding_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mine = bpe.coder(public_tokenizers.path("word_bpe_49k.json"))
    texts = _texts()
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        packed, n = mine.encode(t)
        assert list(struct.unpack(f"<{n}I", packed)) == e.ids, t
        assert mine.decode(packed) == library.decode(e.ids, skip_special_tokens=False)


def _lowest_rank_first(word, merges):
    rank = {m: k for k, m in enumerate(merges)}
    parts = list(word)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_and_heap_against_plain_merging():
    rng = random.Random(2)
    for _ in range(60):
        have, merges = list("abc"), []
        for _ in range(12):
            pair = (rng.choice(have), rng.choice(have))
            if pair not in merges and pair[0] + pair[1] not in have:
                merges.append(pair)
                have.append(pair[0] + pair[1])
        automaton = bpe.MergeAutomaton(merges, list("abc"))
        heap = token_counts.HeapMerger(merges, list("abc"))
        for _ in range(80):
            word = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
            want = _lowest_rank_first(word, merges)
            assert [automaton.labels[s] for s in automaton.walk(word)] == want, (merges, word)
            assert heap.count(bytes("abc".index(c) for c in word)) == len(want)


def test_decoding_holds_labels_only_and_one_python_worker_a_core(spark):
    """The pipeline's last stage pairs no encoder with a decoder in one stage, and what
    decodes holds no automaton."""
    import corpus_pipeline

    text = "Größe and tokens <|endoftext|> 42"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = corpus_pipeline.bpe_round_trip(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, labels = bpe.WordBpe(path), bpe.labels(path)
    assert not hasattr(labels, "automaton")
    got = {r.doc_id: r for r in out.collect()}
    ids, n = coder.encode(text)
    assert (bytes(got[1].ids), got[1].n_tokens, got[1].decoded) == (ids, n, coder.decode(ids))
    assert labels.decode(ids) == coder.decode(ids) and got[2].decoded == got[3].decoded == ""

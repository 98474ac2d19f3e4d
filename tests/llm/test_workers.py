import public_tokenizers as P
import pyarrow as pa

from seepkit.llm.packing import pack
from seepkit.llm.substrings import without_duplicates
from seepkit.llm.tokens import encoder


def held(spark):
    """Chunks that the workers still hold, by a task that is no operator's."""

    def run(batches):
        from seepkit.llm.tokens import _ENCODERS

        for batch in batches:
            n = sum(len(e.cache.young) + len(e.cache.old) for e in _ENCODERS.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int64())], ["n"])

    return max(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(run, "n long").collect())


def test_encoders_go_when_another_operator_runs(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(400)], "doc_id long, text string").repartition(16)
    pack(docs, P.path(KIND), end_id=0, capacity=64).collect()
    for _ in range(3):  # each worker gets a task
        without_duplicates(docs).collect()
    assert held(spark) == 0


def test_encoders_stay_for_their_own_operator():
    from seepkit.llm.workers import tidy

    batch = pa.RecordBatch.from_arrays([pa.array(["a b", "c"])], ["t"])

    def run(batches):
        for b in batches:
            encoder(P.path(KIND), "bytes").encode(b.column(0))
            yield b

    def size():
        return len(encoder(P.path(KIND), "bytes").cache.young)

    assert [*tidy(run, "encoders")([batch])] == [batch] and (n := size())
    assert [*tidy(iter, "encoders")([batch])] == [batch] and size() == n
    assert [*tidy(iter)([batch])] == [batch] and size() == 0


KIND = "byte_bpe_50k.json"

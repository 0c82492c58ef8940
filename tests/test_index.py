import numpy as np
import pytest

from brindle.errors import DimensionMismatch, NotFound
from brindle.operators.index import BinaryIndex, ExactIndex, Int8Index, ListIndex, build_index, index_class, load_index
from brindle.types import CollectionConfig, IndexType, Quantization

KINDS = [({}, ExactIndex), ({"quantization": Quantization.SCALAR_INT8, "index_type": IndexType.IVF}, Int8Index), ({"quantization": Quantization.BINARY}, BinaryIndex), ({"index_type": IndexType.IVF}, ListIndex)]


def frame(spark, x, prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i}", v.tolist()) for i, v in enumerate(x)], "id STRING, vector ARRAY<FLOAT>")


@pytest.mark.parametrize(("options", "kind"), KINDS)
def test_life_cycle(spark, tmp_path, options, kind):
    config = CollectionConfig("i", 16, **options)
    assert index_class(config) is kind
    x = np.random.default_rng(0).standard_normal((300, 16))
    index = build_index(frame(spark, x), config)
    assert len(index) == 300 and index.search(x[4].tolist(), 3).first()["id"] == "v4"
    index = index.insert(frame(spark, [x[4] * 1.0, -x[5]], "n")).insert(frame(spark, [x[7]]))
    assert len(index) == 302 and {r["id"] for r in index.search(x[4].tolist(), 2).collect()} == {"v4", "n0"}
    assert index.search(x[7].tolist(), 1).first()["id"] == "v0"
    index = index.delete("n0")
    if kind is ListIndex:
        index.delete("nobody")
    else:
        with pytest.raises(NotFound):
            index.delete("nobody")
    index.save(str(tmp_path / "x"))
    again = load_index(spark, str(tmp_path / "x"))
    assert type(again) is kind and len(again) == 301
    assert [r["id"] for r in again.search(x[9].tolist(), 5).collect()] == [r["id"] for r in index.search(x[9].tolist(), 5).collect()]
    assert again.rebuild().search(x[9].tolist(), 1).first()["id"] == "v9"
    with pytest.raises(DimensionMismatch):
        index.search([1.0])
    with pytest.raises(DimensionMismatch):
        build_index(frame(spark, x[:, :3]), config)


@pytest.mark.parametrize(("options", "kind"), KINDS)
def test_few_and_none(spark, options, kind):
    config = CollectionConfig("i", 4, **options)
    none = build_index(spark.createDataFrame([], "id STRING, vector ARRAY<FLOAT>"), config)
    assert none.is_empty() and none.search([1.0] * 4, 3).count() == 0
    few = none.insert(frame(spark, np.eye(4)))
    assert few.search([0.0, 1.0, 0.0, 0.0], 1).first()["id"] == "v1"


def test_binary_rerank(spark):
    x = np.random.default_rng(1).standard_normal((400, 16))
    index = build_index(frame(spark, x), CollectionConfig("b", 16, quantization=Quantization.BINARY))
    assert index.rerank(x[3].tolist(), 5).first()["id"] == "v3"

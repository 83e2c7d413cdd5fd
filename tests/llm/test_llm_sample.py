"""The bounded sample holds the features of each labelled text once, in id order, in narrow arrays."""

import numpy as np
from canframes.llm import quality
from canframes.llm.linear import bounded_sample, sparse


def test_sample_is_the_features_of_the_texts_in_id_order(spark):
    texts = {i: " ".join(f"w{(i * j) % 7}" for j in range(3 + i % 5)) for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (3, texts[3]), (100, None)], "doc_id long, text string").repartition(5)
    ids = spark.createDataFrame([(i, i % 2) for i in texts] + [(100, 1)], "doc_id long, label int")
    s = bounded_sample(docs, ids, 100, quality.feature_blocks, quality.DIMS)
    assert s.labels == [str(i % 2) for i in texts] and len(s.fold) == len(texts)
    for k, text in enumerate(texts.values()):
        slots, values = sparse(quality.feature_blocks(text), quality.DIMS)
        mine = s.row == k
        assert np.array_equal(s.col[mine], slots) and np.allclose(s.val[mine], values)
    assert (s.row.dtype, s.col.dtype, s.val.dtype) == (np.int32, np.int32, np.float32)
    empty = bounded_sample(docs.filter("doc_id = 100"), ids, 100, quality.feature_blocks, quality.DIMS)
    assert empty.labels == [] and len(empty.val) == 0

"""Record files in the order in which the files of the documents were written."""

import public_tokenizers

from hopline.llm import token_records
from hopline.session import materialize


def test_order_of_the_files(spark, tmp_path):
    ids = [(i * 37) % 100 for i in range(100)] * 2
    df = spark.createDataFrame([(n, d, f"text {d}") for n, d in enumerate(ids)], "n long, doc_id long, text string")
    docs = materialize(df.repartitionByRange(5, "n").sortWithinPartitions("n").drop("n"), "mixed")
    order = ("_metadata.file_path", "_metadata.row_index")
    index, _ = token_records.export_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"), order=order)
    assert [r["doc_id"] for r in index.orderBy("start").collect()] == ids

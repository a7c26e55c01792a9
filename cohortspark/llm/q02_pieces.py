"""Query op2: SentencePiece ids of every document, and the text they decode to."""

from cohortspark.llm.pieces import encode_decode
from cohortspark.llm.tables import model_path, table

NAME = "op2_sentencepiece"
SQL = None


def query(spark, sf_dir):
    out = encode_decode(table(spark, sf_dir, "documents"), model_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

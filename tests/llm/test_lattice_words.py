"""A word is written once, with the groups of texts that hold it, however many these are."""

import public_tokenizers

from cardloom.llm import lattice


def test_words_are_written_once(spark, monkeypatch):
    rows, write = {}, lattice.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(lattice, "written", counted)
    docs = spark.createDataFrame([(i, f"the same words again w{i % 3}", i % 5 == 1) for i in range(200)], "doc_id long, text string, held_out boolean")
    got = lattice.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), rounds=0).collect()
    assert len(got) == 200 and all(r.n_tokens == r.n_known == 6 for r in got)
    assert max(rows.values()) == 8  # the seven words and the end

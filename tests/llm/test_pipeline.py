import hashlib

import corpus_pipeline
from concord.llm import lines, pieces, quality
from concord.llm.common import table
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_lines import brute as classes
from tests.llm.test_simhash import classes as near_classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs, rows = table(spark, SF, "documents"), None
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, rows = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            scorer = quality.train(docs, table(spark, SF, "labels"))
            assert set(rows) == {i for i, r in before.items() if scorer.score(r.text) < quality.REJECT}
        elif k == 1:
            cls, seen = classes([r.text for r in before.values()]), set()
            for i in sorted(before):
                own = []
                for x in lines.split(before[i].text):
                    p = lines.plain(x)
                    if not p or cls[p] not in seen:
                        own.append(x)
                    seen |= {cls[p]} if p else set()
                assert rows[i].text == "\n".join(own)
                assert rows[i].n_chars == (len(rows[i].text) if rows[i].text != before[i].text else before[i].n_chars)
        elif k == 2:
            of = near_classes([(i, r.text) for i, r in sorted(before.items())])
            assert set(rows) == set(of.values())
        elif k == 3:
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            bad = {i for i, r in before.items() if (h := hits(r.text, items))[1] and 20 * h[1] >= h[0]}
            assert set(rows) == set(before) - bad
        else:
            model = pieces.model_at(pieces.default_model())
            assert all(model.decode(r.ids) == before[i].text and r.lossless for i, r in rows.items()) and set(rows) == set(before)
        docs, kept[k] = out, set(rows)
    again = {r.doc_id: hashlib.sha256(str(r.ids).encode()).hexdigest() for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == {i: hashlib.sha256(str(r.ids).encode()).hexdigest() for i, r in rows.items()}

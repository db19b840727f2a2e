from docloom.operators import embed
from docloom.plans import engine

MODEL = embed.HashingEmbedder(64)
SEG = "document_id string, source_name string, file_path string, file_type string, page_number int, text string"
TEXTS = {
    "loan.txt": "Applicant name: Ada Stone\nApplication number: FRM-1234\nPhone: (555) 010-1234 55\nE-mail: ada@mill.example\nRate: 3.5",
    "manual.txt": "The harbour manual describes the quarterly audit of every crane. The survey crew repairs the northern depot before the first of May.\n\nSection 7 covers the recovery of the depot after a flood.",
}


def rows(spark, texts):
    return spark.createDataFrame([(n.replace(".", "_"), n, f"/lib/{n}", "txt", None, t) for n, t in texts.items()], SEG)


def empties(spark):
    return (
        spark.createDataFrame([], "document_id string, source_name string, file_path string, file_type string, page_number int, chunk_id string, chunk_index int, total_chunks int, text string"), spark.createDataFrame([], "source_name string, sha string"), spark.createDataFrame([], "model string, sha string, embedding array<float>"),
    )


def test_sync_reuses_unchanged_sources(spark):
    chunks, hashes, cache = empties(spark)
    first = [x.cache() for x in engine.sync(rows(spark, TEXTS), chunks, hashes, cache, MODEL)]
    assert first[0].count() == first[1].count() == 2
    again = engine.sync(rows(spark, TEXTS), first[0], first[2], first[3], MODEL)
    assert again[0].count() == 2 and again[3].count() == first[3].count()
    changed = engine.sync(rows(spark, {"loan.txt": TEXTS["loan.txt"], "new.txt": "Another text."}), first[0], first[2], first[3], MODEL)
    assert {r.source_name for r in changed[0].collect()} == {"loan.txt", "new.txt"} and changed[3].count() == 3


def test_ask(spark):
    chunks, hashes, cache = empties(spark)
    c, v, _, _ = engine.sync(rows(spark, TEXTS), chunks, hashes, cache, MODEL)
    c, v = c.cache(), v.cache()
    q = spark.createDataFrame([(1, "what is the applicant name"), (2, "what does section 7 cover in the manual"), (3, "give me the contact details of the applicant"), (4, None), (4, None)], "query_id long, text string")
    out = {r.query_id: r for r in engine.ask(q, c, v, MODEL, distance_scale=0.6).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].route == "extract" and "Ada Stone" in out[1].answer and out[1].sources[0].source_number == 1
    assert out[2].route in ("section", "none") and out[3].route in ("contact", "extract", "none")
    assert engine.ask(q.limit(0), c, v, MODEL, distance_scale=0.6).count() == 0


def test_cache_embeds_a_text_once(spark):
    _, _, cache = empties(spark)
    texts = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", None)], "k string, text string")
    found, grown = embed.with_cache(texts, "k", cache, MODEL)
    assert found.count() == 2 and grown.count() == 1

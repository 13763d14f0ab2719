"""Entities alone, from texts of any kind."""

from threadloom.plans.memory import Memory


class Names:
    """Says that each capitalised word of the text is a thing; fails on texts with `bad`."""

    def generate(self, prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("bad")
        said = [p.rsplit("Text:\n", 1)[1].split() for p in prompts]
        return ["##".join([*(f'("entity"|"{w}"|thing)' for w in s if w[0].isupper()), '("entity"|nothing)', "END"]) for s in said]


def test_entities_alone(spark, tmp_path):
    memory = Memory(spark, str(tmp_path), generator=Names)
    long = "Rome " + "x" * 200
    rows = spark.createDataFrame([(0, "Ann met Bob"), (1, ""), (2, None), (3, "so bad Ann"), (4, long)], "chunk_id long, text string")
    got = {tuple(r) for r in memory.named(rows).select("chunk_id", "place", "entity", "type", "source_text").collect()}
    assert got == {(0, 0, "Ann", "thing", "Ann met Bob"), (0, 1, "Bob", "thing", "Ann met Bob"), (4, 0, "Rome", "thing", long[:100] + "...")}
    assert {(r["stage"], r["phase"]) for r in memory.calls().collect()} == {("entities", "build")} and memory.calls().where("error is not null").count() == 1

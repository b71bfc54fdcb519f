"""Incremental id mapping with snapshots."""

import random

from splicelake.operators.idmapping import mapping_hits, resolve_collision
from splicelake.streaming.idmap import HITS, MAPPING_SCHEMA, current_ids, live_paths, snapshot, stream_id_mapping


def test_readers_see_one_snapshot_and_the_batches_behind_it(spark, tmp_path):
    """50 files in 25 batches, folded every six."""
    rnd = random.Random(8)
    proteins = spark.createDataFrame([(i, f"NP_{i}", f"ENST{i}.1") for i in range(40)], "protein_key long, protein_refseq_id string, transcript_ensembl_id string")
    lines = [(k, f"P{rnd.randint(0, 9)}", rnd.choice([f"NP_{rnd.randrange(40)}", ""]), rnd.choice([f"ENST{rnd.randrange(40)}.1", f"ENST{rnd.randrange(40)}", ""])) for k in range(400)]
    mapping = spark.createDataFrame(lines, MAPPING_SCHEMA)
    source, hits = str(tmp_path / "in"), str(tmp_path / "hits")
    mapping.repartition(50).write.parquet(source)
    stream_id_mapping(spark, source, proteins, hits, str(tmp_path / "cp"), files_per_trigger=2, snapshot_every=6).awaitTermination()
    assert [p.rsplit("/", 1)[1] for p in live_paths(spark, hits)] == ["upto=23", "batch=24"]
    want = resolve_collision(mapping_hits(proteins, mapping).select("protein_key", *HITS))
    assert sorted(map(tuple, current_ids(spark, hits).collect())) == sorted(map(tuple, want.collect()))
    # A batch that is retried folds from the snapshot before its own.
    before = sorted(map(tuple, current_ids(spark, hits).collect()))
    assert [p.rsplit("/", 1)[1] for p in live_paths(spark, hits, before=23)][0] == "upto=17"
    snapshot(spark, hits, 23)
    assert sorted(map(tuple, current_ids(spark, hits).collect())) == before
    assert not [f for f in current_ids(spark, hits).inputFiles() if "batch=" in f and "batch=24" not in f]

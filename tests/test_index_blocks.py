"""Stored indexes in blocks: written without a shuffle, and complete where contigs are cut."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandloom.config import SearchConf
from strandloom.operators import search, seeds


@pytest.mark.parametrize("k, two, errors", [(10, False, 2), (12, True, 2), (24, False, 0), (16, False, 3)])
def test_blocks_cut_anywhere_give_all_hits(spark, tmp_path, k, two, errors):
    r = random.Random(k)
    texts = [(c, "".join(r.choice("ACGTN" if c == 2 else "ACGT") for _ in range(n))) for c, n in enumerate((900, 3, 350, 64, 65))] + [(9, None), (10, "")]
    reads = []
    for i in range(120):
        text = texts[i % 2 * 2][1]
        at = r.randrange(len(text) - 48)
        read = list(text[at : at + 48])
        for j in r.sample(range(48), errors):
            read[j] = r.choice("ACGT")
        reads.append((i, "".join(read)))
    rd, ct = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(texts, "contig_id long, seq string")
    conf = SearchConf(errors=errors, bisulfite=two)
    seeds.write_search_index(ct, f"{tmp_path}/own", k, two, 60, 2, 300, 64)
    index = seeds.read_search_index(spark, f"{tmp_path}/own")
    assert index.blocks.count() > 4
    assert {(x.contig_id, x.length) for x in index.contigs.collect()} == {(c, len(t or "")) for c, t in texts}
    got = {tuple(x) for x in search.indexed(rd, index, conf).collect()}
    assert got == {tuple(x) for x in search.search(rd, ct, conf).collect()} and len(got) >= 60


def test_an_index_is_written_without_a_shuffle(spark, tmp_path):
    """A row for each block, not one for each base."""
    ct = spark.createDataFrame([(c, "ACGGT" * 400) for c in range(50)], "contig_id long, seq string").coalesce(1)
    seeds.write_search_index(ct, f"{tmp_path}/own", 12)
    assert seeds.read_search_index(spark, f"{tmp_path}/own").blocks.count() == 1
    index = seeds.read_search_index(spark, f"{tmp_path}/own")
    with pytest.raises(ValueError, match="reads of up to"):
        search.candidates(spark.createDataFrame([(1, "ACGGT" * 300, 0)], "read_id long, seq string, max_errors int"), None, 12, index=index)


def test_block_has_the_words_that_begin_in_its_own_part():
    text = np.frombuffer(b"ACGTACGTNNACGT", np.uint8)
    keys, firsts, places = seeds.block(text, np.array([0, 8, 14]), np.array([[0, 4], [10, 14]]), 4, False)
    found = {int(k): places[a:b].tolist() for k, a, b in zip(keys, firsts, firsts[1:])}
    assert found == {seeds.key_of("ACGT", 4): [0, 10], seeds.key_of("CGTA", 4): [1], seeds.key_of("GTAC", 4): [2], seeds.key_of("TACG", 4): [3]}


def test_blocks_have_no_statistics(spark, tmp_path):
    """A writer keeps the least and greatest value of a column, here whole arrays, for each row group until its file is closed."""
    ct = spark.createDataFrame([(c, "ACGGTCATTG" * 40) for c in range(40)], "contig_id long, seq string").coalesce(1)
    seeds.write_search_index(ct, f"{tmp_path}/own", 12, size=1000)
    told = [pq.ParquetFile(f).metadata for f in (tmp_path / "own" / "blocks").glob("*.parquet")]
    columns = [m.row_group(g).column(c) for m in told for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert columns and not any(c.is_stats_set and c.statistics.has_min_max for c in columns)
    assert seeds.read_search_index(spark, f"{tmp_path}/own").blocks.count() > 4

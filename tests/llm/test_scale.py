"""Plans that change with the size of the input give the same results."""

import numpy as np
import pytest

from larkspur.llm import simhash, tokens


@pytest.mark.parametrize("k", [1, 2, 3])
def test_links_for_any_number_of_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for x in fp[:60] for n in (1, 3, 4)]
    fp = np.unique(np.concatenate([fp, np.array(near, np.uint64)]))
    a = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3

    def groups(pairs):
        low = {int(x): int(x) for x in fp}
        for _ in range(len(fp)):
            moved = False
            for x, y in pairs:
                m = min(low[x], low[y])
                moved |= low[x] != m or low[y] != m
                low[x] = low[y] = m
            if not moved:
                return low
        return low

    want = groups([(int(fp[i]), int(fp[j])) for i, j in np.argwhere(a) if i < j])
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(frame, k=k, split=40).collect()]
    assert groups(found) == want and all((x ^ y).bit_count() <= 3 for x, y in found)


def test_choice():
    assert [simhash.choice(n, 3) for n in (10**5, 6 * 10**7, 10**9, 3 * 10**10, 10**11)] == [1, 1, 2, 2, 3]


def test_files_have_what_readers_skip_by(spark, tmp_path):
    import glob

    from pyarrow import orc

    docs = spark.range(30000).selectExpr("id * 2 as doc_id", "concat('word ', id, repeat(' more', 20)) as text")
    tokens.write_tokens(docs, str(tmp_path), shards=2, index_stride=1000, stripe_bytes=1 << 12)
    files = sorted(glob.glob(f"{tmp_path}/data/*.orc"))
    assert len(files) == 2 and max(orc.ORCFile(f).nstripes for f in files) > 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    footer = reader.getStripes().get(0)
    assert footer.getIndexLength() > 0 and reader.getRowIndexStride() == 1000
    columns = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    columns[1] = True
    stripes = reader.rows().readRowIndex(0, columns, columns)
    assert stripes.getBloomFilterIndex()[1].getBloomFilterCount() > 0
    r = tokens.read_documents(spark, str(tmp_path), [10, 11, 59998])
    assert "PushedFilters: [In(doc_id" in r._jdf.queryExecution().toString()
    assert sorted(x.doc_id for x in r.collect()) == [10, 59998]
    assert [tokens.shards_for(n) for n in (0, 1, 10**9, 10**14)] == [1, 1, 60, 186265]

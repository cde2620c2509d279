from helica.sources.vcf import VcfHeader
from helica.streaming.line_streams import stream_qseq, stream_qseq_with_rejects, stream_sam, stream_vcf
from tests.make_reads import HEADER
from tests.test_fragments import QSEQ
from tests.test_variants import LINES, TOP


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}")


def test_qseq_stream(spark, tmp_path):
    (tmp_path / "a").write_text(QSEQ[0] + "\n")
    (tmp_path / "b").write_text(QSEQ[1] + "\nbroken\n")
    assert drain(stream_qseq(spark, str(tmp_path), 1, mode="DROPMALFORMED"), "s1").count() == 2
    good, bad = stream_qseq_with_rejects(spark, str(tmp_path))
    assert drain(good, "s2").count() == 2 and drain(bad, "s3").first().fail_reason == "columns"


def test_sam_and_vcf_streams(spark, tmp_path):
    for n in ("sam", "vcf"):
        (tmp_path / n).mkdir()
    (tmp_path / "sam" / "a").write_text("r1\t0\tchr21\t5\t9\t4M\t*\t0\t0\tACGT\tIIII\n")
    (tmp_path / "vcf" / "a").write_text(TOP + "\n".join(LINES) + "\n")
    assert drain(stream_sam(spark, str(tmp_path / "sam"), HEADER), "s4").first().ref_index == 20
    assert drain(stream_vcf(spark, str(tmp_path / "vcf"), VcfHeader.parse(TOP)), "s5").count() == len(LINES)

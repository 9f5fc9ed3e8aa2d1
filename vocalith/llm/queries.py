"""Queries of the training-data operators; their SQL is in ``sql``."""

from __future__ import annotations

from vocalith.llm.encode import encode_texts
from vocalith.llm.mixing import mix_sources
from vocalith.llm.overlap import cross_split_pairs, overlap_links, overlap_report
from vocalith.llm.pii import find_personal, mask_personal
from vocalith.llm.runs import collapse_runs
from vocalith.llm.splits import grouped_split, utterance_groups
from vocalith.llm.sql import SQL  # noqa: F401
from vocalith.llm.terms import marked_terms
from vocalith.llm.turns import speaker_turns
from vocalith.llm.unify import look_classes, same_look_pairs, unify_texts
from pyspark.sql import functions as F

from vocalith.session import table


def p5_found(spark, sf_dir):
    return same_look_pairs(table(spark, sf_dir, "supervisions"))


def p5_texts(spark, sf_dir):
    return unify_texts(table(spark, sf_dir, "supervisions"))


def p6_found(spark, sf_dir):
    return cross_split_pairs(table(spark, sf_dir, "supervisions"))


def p5_classes(spark, sf_dir):
    return look_classes(table(spark, sf_dir, "supervisions"))


def p6_links(spark, sf_dir):
    return overlap_links(table(spark, sf_dir, "supervisions"))


def p6_report(spark, sf_dir):
    return overlap_report(table(spark, sf_dir, "supervisions"))


def p1_found(spark, sf_dir):
    return speaker_turns(table(spark, sf_dir, "supervisions")).select("id", "turn_no", "speaker_no")


def p1_turns(spark, sf_dir):
    return speaker_turns(table(spark, sf_dir, "supervisions"))


def p2_found(spark, sf_dir):
    return marked_terms(table(spark, sf_dir, "supervisions")).where("mark is not null").select("term", "mark")


def p2_terms(spark, sf_dir):
    return marked_terms(table(spark, sf_dir, "supervisions")).drop("n")


def p2_ngrams(spark, sf_dir):
    """Runs of up to three terms."""
    return marked_terms(table(spark, sf_dir, "supervisions"), max_n=3)


def p3_found(spark, sf_dir):
    return utterance_groups(table(spark, sf_dir, "utt2spk"))


def p3_splits(spark, sf_dir):
    labels = table(spark, sf_dir, "supervisions").select(F.col("id").alias("utt_id"), F.col("corpus").alias("label"))
    return grouped_split(utterance_groups(table(spark, sf_dir, "utt2spk")), labels)


def _runs(spark, sf_dir, single):
    return collapse_runs(table(spark, sf_dir, "token_spans"), table(spark, sf_dir, "symbols"), single=single)


def p7_found(spark, sf_dir):
    return _runs(spark, sf_dir, False).select("utt_id", "start_frame", "end_frame", "n_spans")


def p7_events(spark, sf_dir):
    return _runs(spark, sf_dir, True)


def p8_ids(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"))


def _mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark, sf_dir):
    return _mix(spark, sf_dir)[0]


def p9_shares(spark, sf_dir):
    return _mix(spark, sf_dir)[1]


def p10_found(spark, sf_dir):
    return find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts")).select("doc_id", "kind", "start_char")


def p10_masked(spark, sf_dir):
    return mask_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_turns, p2_found, p2_terms, p2_ngrams, p3_found, p3_splits, p5_found, p5_texts, p5_classes, p6_found, p6_links, p6_report, p7_found, p7_events, p8_ids, p9_mix, p9_shares, p10_found, p10_masked)
}

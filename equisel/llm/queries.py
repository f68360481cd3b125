"""Registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from . import chunkdedup, dac, decontam, lzprint, neardup, packing, pseudolm, quality, substring, toxicity, trie, urls, whitening
from .store import table


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op2_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_token_files(spark, sf_dir):
    return dac.documents(spark, dac.write(table(spark, sf_dir, "documents")), with_ids=False)


def op5_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lz_fingerprint(spark, sf_dir):
    return lzprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_url_decisions(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).drop("component")


def op8_decontamination(spark, sf_dir):
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_substring_dedup(spark, sf_dir):
    return substring.digest(substring.passages(table(spark, sf_dir, "documents")))


def op10_pseudo_likelihood(spark, sf_dir):
    return pseudolm.likelihoods(table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.components(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_chunk_dedup(spark, sf_dir):
    return chunkdedup.digest(chunkdedup.duplicates(table(spark, sf_dir, "documents")))


def op13_conversation_trie(spark, sf_dir):
    return trie.digest(trie.trie(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_quality, op3_minhash_neardup, op4_token_files, op5_toxicity, op6_lz_fingerprint, op7_url_decisions,
    op8_decontamination, op9_substring_dedup, op10_pseudo_likelihood, op11_whitening, op12_chunk_dedup, op13_conversation_trie)}
SQL = {"op3_minhash_neardup": neardup.SQL, "op7_url_decisions": urls.SQL, "op8_decontamination": decontam.SQL, "op9_substring_dedup": substring.SQL,
       "op12_chunk_dedup": chunkdedup.SQL, "op13_conversation_trie": trie.SQL}

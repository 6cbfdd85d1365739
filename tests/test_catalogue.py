import pytest

from conftest import SF, same
from glyphlake.plans import catalogue, lattices, lexical  # noqa: F401

#: The others run in the driver's comparison.
NAMES = ["normalized_corpus", "reject_reasons", "alphabet", "word_budget_prefix", "duration_budget_sample", "symbol_encode", "adjacent_dedup_runs", "ngram_counts_3", "kn_interpolated_bigram", "lexical_model", "alignment_arcs", "lex_prune_topk", "lex_smooth", "forward_loglik", "viterbi_loglik", "sausage_truncate", "segment_chunks", "star_join", "two_pass_corpus", "trainable_lines", "lexicon_arcs", "lexicon_pronunciation", "base_symbol_map", "kn_interpolated_trigram", "phi_score", "unknown_word_injection", "boundary_pairs_removed", "lpt_assignment", "line_shards", "graph_prune", "compose_best_cost", "frame_runs", "glossary_isolation", "em_contextfree_lexicon"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())

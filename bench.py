"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is warmed once and then timed (median of $BENCH_RUNS, one by default) into a no-op
sink, so every row is produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans import all_queries  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_usable_documents", "corpus_build", "P05_clean_markdown", "P07_html_sections", "P09_normalize_text",
    "P13_ascii_id", "F01_topic_filter", "F02_raw_topic_filter", "A04_exact_dedup", "A05_clean_counters", "A06_chunk_stats",
    "A14_profile_documents", "D01_split_text", "D02_chunk_documents", "D03_fixed_windows", "W01_select_documents", "W02_budget_stop",
    "S08_node_upsert", "S09_edge_upsert", "A08_entity_dedup", "A13_degrees", "J05_neighbours", "J06_question_neighbours",
    "W04_ranked_relations", "J07_paths", "J07_paths_four_hops", "X07_extracted_aliases", "A10_alias_conflicts", "J03_mentions",
    "J03_mentions_in_documents", "T01_vector_topk", "T02_vector_topk_approx", "J13_cache_lookup", "J09_title_layer",
    "J10_semantic_layer", "J11_comention_scores", "U02_fetched_documents", "X03_passage_score", "W08_packed_passages",
    "W07_packed_graph_lines", "D08_retrieve", "A17_answer_scores", "A19_score_summary", "A21_usage_cost", "X11_salvaged_replies",
    "P19_citations", "X06_coreference", "R01_sessions", "R06_failure_streaks", "R06_availability_states",
    "J07_whole_graph", "U04_hybrid_with_paths", "A14_profile_sketched", "T02_inverted_lists",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, spark__ui__showConsoleProgress="false")
    catalog, seconds = all_queries(), {}

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in wanted:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

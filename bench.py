"""Headline timings: the batch chain stage by stage, then queries on its tables.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from sentrygrain.plans import catalog
from sentrygrain.plans.pipeline import Pipeline
from sentrygrain.session import local_session

QUERIES = (
    "b06_dataset_summary",
    "b01_event_ids",
    "c04_transitions",
    "f29_all_features",
    "r16_evidence_state",
    "r24_cooldown_and_escalation",
    "r27_score_frame",
    "d02_decayed_counts",
    "d05_ewma_second_moments",
    "d10_drift_evaluation",
    "v01_budget_mask",
    "v03_average_precision",
    "v08_budget_sweep",
    "v15_per_attack_type",
    "v17_campaign_report",
    "q02_alert_timeline",
    "q06_top_risk_entities",
    "q18_entity_summaries",
    "q19_behaviour_cards",
    "s01_live_scoring",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name, action):
        began = time.perf_counter()
        out = action()
        timings[name] = round(time.perf_counter() - began, 3)
        return out

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    p = Pipeline.of(spark, folder)
    n = timed("stage_events", lambda: p.events.count())
    timed("stage_profiles", lambda: (p.cutoff, p.profiles))
    timed("stage_features", lambda: p.features)
    timed("stage_rule_scores", lambda: p.given_scores)
    timed("stage_rule_risk", lambda: p.given_risk)
    timed("stage_rule_alerts", lambda: p.given_alerts[0].count())
    timed("stage_forest_fit", lambda: p.forest_nodes)
    timed("stage_forest_scores", lambda: p.scores.write.format("noop").mode("overwrite").save())
    timed("stage_forest_risk", lambda: p.risk)
    for name in QUERIES:
        run = catalog.QUERIES[name]
        timed(name, lambda run=run: run(spark, folder).write.format("noop").mode("overwrite").save())
    chain = sum(v for k, v in timings.items() if k.startswith("stage_"))
    print(
        json.dumps(
            {
                "metric": "batch chain and headline queries, wall time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "events": n,
                "events_per_second_chain": round(n / chain, 1),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()

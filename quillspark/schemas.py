"""Schemas of what is read and written."""

QUESTIONS = "question_id string, question string, gold_answer string, gold_source_ids array<string>, distractors array<string>, key_facts array<string>, category string, difficulty string"
RESULTS = (
    "config_name string, question_id string, question_text string, question_category string, question_difficulty string, chunks_retrieved int, retrieval_latency_ms double, generation_latency_ms double, total_latency_ms double, context_tokens int, "
    "context_precision double, context_recall double, distractor_rate double, gold_similarity double, fact_recall double, missing_facts array<string>, generated_answer string, gold_answer string"
)
#: Columns that a result line may lack.
OPTIONAL_RESULTS = ("missing_facts", "generated_answer", "gold_answer")

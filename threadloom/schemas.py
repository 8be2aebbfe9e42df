"""Schemas of the store's tables; columns that were added later are part of the base schema."""

EMAILS = "id bigint, message_id string, subject string, from_name string, from_email string, date string, body string, list_name string, thread_id string, in_reply_to string, refs string, priority string, relevance_score double, relevance_reason string, raw_json_path string, processed int, created_at double"
THREADS = "id string, root_message_id string, subject string, start_date string, end_date string, email_count bigint, participant_count bigint, summary_zh string, key_points string, consensus string, design_decisions string, related_files string, related_functions string, tags string, processed int, translated_html_path string, created_at double, hidden int"
REPORTS = "id bigint, topic string, report_type string, content string, source_thread_ids string, created_at double"
JOBS = "id bigint, keywords string, date_from string, date_to string, list_name string, status string, total_found bigint, total_relevant bigint, progress string, last_search_time string, created_at double, updated_at double"
QUEUE = "id bigint, job_id bigint, root_message_id string, subject string, source_url string, relevance_score double, relevance_reason string, status string, priority int, retry_count int, created_at double, updated_at double"
TOPICS = "id bigint, name string, display_name string, description string, keywords string, created_at double"
LINKS = "thread_id string, topic_id bigint, confidence double, created_at double"
CACHE = "cache_key string, backend string, translated string, created_at double, access_count int"

TABLES = {"emails": EMAILS, "threads": THREADS, "knowledge_reports": REPORTS, "collect_jobs": JOBS, "collect_queue": QUEUE, "topics": TOPICS, "thread_topics": LINKS, "cache": CACHE}
KEYS = {"emails": ["message_id"], "threads": ["id"], "knowledge_reports": ["id"], "collect_jobs": ["id"], "collect_queue": ["job_id", "root_message_id"], "topics": ["name"], "thread_topics": ["thread_id", "topic_id"], "cache": ["cache_key"]}

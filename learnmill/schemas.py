"""Schemas of the tables, as DDL."""

USER_SESSIONS = "session_id string, user_id string, session_start timestamp, session_end timestamp, mode string, metadata map<string,string>"
KNOWLEDGE_CHUNKS = "chunk_id string, content string, chunk_type string, source string, metadata map<string,string>"
TEXTBOOK_CHUNKS = (
    "chunk_id string, book_id string, chapter_id string, chunk_number int, title string, content string, content_type string, "
    "section_title string, subject string, grade_level int, key_concepts array<string>, definitions map<string,string>, "
    "word_count int, page_range struct<start:int,end:int>, source_location string, embedding array<float>"
)
GRAPH_NODES = "graph_name string, node_id long, label string, properties string"
GRAPH_EDGES = "graph_name string, edge_id long, start_node_id long, end_node_id long, edge_label string, properties string"
CHUNK_CONCEPT_LINKS = "chunk_id long, node_id long, relevance double"
SKILLS_REGISTRY = "skill_id string, skill_name string, subject string, grade_level int, description string"
LEARNING_EVENTS = (
    "event_id long, user_id string, skill_id string, is_correct boolean, attempts int, time_spent_seconds int, "
    "timestamp timestamp, event_type string, source_text string, metadata map<string,string>"
)
STUDENT_SKILLS = (
    "user_id string, skill_id string, probability_mastery double, total_attempts long, correct_attempts long, "
    "consecutive_correct long, consecutive_incorrect long, last_attempt_at timestamp"
)
QUESTIONS = (
    "question_id string, source string, question_text string, question_type string, correct_answer string, distractors array<string>, "
    "subject string, topic string, difficulty string, grade_level int, explanation string, embedding array<float>, metadata map<string,string>"
)
BANK_QUESTION = (
    "id string, type string, subject string, difficulty string, stem string, options array<string>, correct_answer string, "
    "explanation string, chapter_ref string, section_ref string, tags array<string>"
)
CLICK_EVENTS = "event_id long, user_id string, x int, y int, element_id string, timestamp timestamp"
CONCEPTS = "concept_id string, name string, description string, definition string, book_id string, chunk_ids array<string>, metadata map<string,string>"
RELATIONSHIPS = "source_id string, target_id string, relationship_type string, strength double, metadata map<string,string>"

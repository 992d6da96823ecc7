"""Default settings and the fixed word lists the operators compare against."""

from __future__ import annotations

# --- fixed values: results depend on them -----------------------------------
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
MIN_DOC_CHARS = 50
MIN_PAGE_CHARS = 100
MAX_PAGES = 50
MAX_DEPTH = 3
TOP_K = 5
SIMILARITY_THRESHOLD = 0.3
CONTEXT_CHARS = 4000
CONTEXT_RESERVE = 20
CONTEXT_MIN_ROOM = 100
ANSWER_CHARS = 1000
SNIPPET_CHARS = 200
EMBED_DIM = 384

SUMMARY_FILE = "crawl_summary.json"
UPLOAD_EXTENSIONS = (".txt", ".md", ".json", ".pdf")
SKIPPED_LINK_EXTENSIONS = (".pdf", ".doc", ".docx", ".zip", ".jpg", ".png", ".gif")

REMOVED_TAGS = ("script", "style", "nav", "header", "footer")

UNSAFE_PHRASES = (
    "ignore previous instructions",
    "forget everything",
    "new instructions:",
    "system prompt",
    "you are now",
    "roleplay as",
    "pretend to be",
    "act as if",
    "disregard",
    "override",
)

REFUSAL_PHRASES = (
    "I don't have enough information",
    "The crawled content doesn't contain",
    "Not found in crawled content",
)

ANSWER_NOT_FOUND = "I don't have enough information in the crawled content to answer this question."
ANSWER_INSUFFICIENT = "The crawled content doesn't contain sufficient information about this topic."
ANSWER_UNSAFE = "I cannot process this request due to safety concerns."
ANSWER_ERROR = "An error occurred while processing your question."
ANSWER_PREFIX = "Based on the crawled content: "

DEFINITION_WORDS = ("what is", "what are", "define")
EXPLANATION_WORDS = ("how", "why", "when", "where")
# ----------------------------------------------------------------------------

HASH_MODEL = "token-hash-md5"

# A question matrix is only broadcast while it stays within both bounds.
BROADCAST_QUESTIONS = 16_384
BROADCAST_BYTES = 128 * 1024 * 1024

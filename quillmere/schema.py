"""Tables of the registries, their states and the engine's default settings."""

from __future__ import annotations

FILES = "id long, path string, added_at long, status string, status_detail string, status_note string, last_mtime long, last_size long, last_hash string, last_indexed long, attempts long, last_attempt long"
CHUNKS = "id string, path string, ordinal int, content string, content_hash string, heading_path string, page_number int, token_count int, created_at long, n_terms int"
POSTINGS = "term string, chunk_id string, at array<int>, dl int, tier int"
RESULTS = "path string, outcome string, detail string, chunks long"
CONVERSIONS = "input_path string, outcome string, detail string, output_path string"
VECTORS = "chunk_id string, embedding array<float>"
OUTPUTS = "id long, input_path string, output_path string, added_at long, status string, status_detail string, status_note string, last_src_mtime long, last_src_size long, last_src_hash string, last_out_hash string, last_converted long, extractor string, attempts long, last_attempt long"
SOURCES = "id long, name string, kind string, uri string, strategy string, config string, enabled boolean, added_at long, last_crawled long, last_run_id long, last_status string, last_error string"
RUNS = "id long, source_id long, strategy string, started_at long, finished_at long, discovered long, updated long, gone long, skipped long, errors long, status string, note string"
DOCUMENTS = "id long, source_id long, uri string, name string, rel_path string, extension string, size long, modified_ms long, content_hash string, metadata string, status string, status_note string, discovered_at long, first_run_id long, last_seen long, last_run_id long"

# The states that stored rows carry.
FILE_STATES = ("pending", "indexed", "failed", "missing", "unsupported", "excluded", "too_large", "needs_ocr")
OUTPUT_STATES = ("pending", "converted", "conflict", "failed", "missing", "unsupported", "excluded", "too_large", "needs_ocr")
DOCUMENT_STATES = ("present", "modified", "gone", "too_large", "error")

# Extensions that discovery records.
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "rtf", "odt", "pages", "txt", "md", "markdown", "xls", "xlsx", "ods", "numbers", "csv", "tsv", "ppt", "pptx", "odp", "key", "epub")

# Defaults of the settings.
DEFAULTS = {
    "embedding.model": "hash",
    "chunking.target_tokens": 400, "chunking.max_tokens": 800, "chunking.overlap_tokens": 50, "embedding.batch_size": 64, "embedding.dimension": 1024,
    "files.size_cap_bytes": 52_428_800, "indexing.extract_concurrency": 3, "retrieval.default_k": 10, "retrieval.rrf_constant": 60,
    "output.dir": "converted", "output.annotate": True, "output.collision_aware_naming": True, "convert.size_cap_bytes": 104_857_600,
    "crawl.hash": False, "crawl.follow_symlinks": False, "crawl.default_strategy": "recursive", "crawl.default_max_depth": 0, "documents.size_cap_bytes": 0,
}
# Settings that may be zero, that follow from others, and that stand while there are chunks; other numbers are at least 1.
ZERO_ALLOWED = frozenset(("chunking.overlap_tokens", "convert.size_cap_bytes", "files.size_cap_bytes", "crawl.default_max_depth", "documents.size_cap_bytes"))
DERIVED = frozenset(("embedding.dimension",))
WITHOUT_CHUNKS = frozenset(("embedding.model",))

# Kinds of sources and strategies, with their other names.
KINDS = {"local": ("dir", "directory"), "smb": ("share", "unc", "nfs"), "library": ("sharepoint", "sp", "graph")}
STRATEGIES = {"recursive": ("full", "deep"), "shallow": ("top",), "incremental": ("delta", "since"), "targeted": ("glob", "pattern")}


def named(name: str, names: dict[str, tuple[str, ...]]) -> str:
    """The name that a name or another name for it, in any case, stands for."""
    low = name.lower()
    for own, others in names.items():
        if low == own or low in others:
            return own
    raise ValueError(f"{name} is none of {', '.join(names)}")

"""Fixed values of the provenance data model."""

# Artifact type -> (id prefix, category, default folder).
NODE_TYPES = {
    "raw": ("RAW", "sources", "data/raw"),
    "input": ("IN", "sources", "data/inputs"),
    "resource": ("RES", "resources", "resources"),
    "pipeline": ("PL", "process", "pipelines"),
    "step": ("SP", "process", "pipelines"),
    "script": ("SC", "process", "scripts"),
    "result": ("R", "outputs", "results/other"),
    "table": ("T", "outputs", "results/tables"),
    "figure": ("F", "outputs", "results/figures"),
    "supplement": ("S", "writing", "results/supplementary"),
    "section": ("TX", "writing", "articles"),
    "article": ("A", "writing", "articles"),
    "note": ("N", "notes", "notes"),
}

# Relations between artifacts.
RELATIONS = ["feeds", "produces", "derives", "code", "part_of", "documents", "related", "variant"]
HARD_RELS = ["feeds", "produces", "derives", "code"]
SOFT_RELS = ["documents", "related", "variant"]
FOCUS_IGNORE_RELS = ["documents", "related"]
GROUPING_RELS = ["feeds", "produces", "derives"]
UNUSUAL_PARAM_RELS = ["code", "part_of", "related", "documents"]
PARAM_RELS = ["produces", "derives"]

# Other vocabularies.
PROCESS_TYPES = ["pipeline", "step", "script"]
OUTPUT_TYPES = ["table", "figure", "result", "supplement"]
NO_PATH_EXPECTED = ["note", "article", "pipeline", "step"]
MODES = ["managed", "ref"]
BRANCH_STATUSES = ["main", "alternative", "abandoned"]
ANALYSIS_STATUSES = ["done", "open", "superseded", "planned"]
NOTE_KINDS = ["note", "issue"]
DECISIONS = ["accepted", "accepted with edits", "partly applied", "needs author", "not applied"]
COMPONENT_RANK = {"section": 0, "figure": 1, "table": 2, "supplement": 3}

# Parameter names that only change how a figure looks.
COSMETIC_WORDS = ["font", "fontsize", "color", "colour", "colors", "colours", "width", "height", "dpi", "theme",
                  "opacity", "title", "legend", "linewidth", "palette", "figsize", "cmap", "colormap", "markersize"]
COSMETIC_PAIRS = [("label", "size"), ("point", "size"), ("marker", "size"), ("line", "width"), ("fig", "size")]

# File name rules of the monitor (add the state folder of your own tools as an extra pattern).
IGNORE_GLOBS = [
    ".git/*", "*/.git/*", "*/__pycache__/*", "*.pyc", "*/.ipynb_checkpoints/*", "*/node_modules/*",
    "*.tmp", "*.swp", "~$*", "*/~$*", ".DS_Store", "*/.DS_Store", "Thumbs.db", "*.lock",
    "*.done", "*/.snakemake/*", "*/logs/*", "*.log", "*.bak",
]
TYPE_EXTENSIONS = {
    "figure": [".png", ".jpg", ".jpeg", ".svg", ".pdf", ".tif", ".tiff", ".gif", ".webp"],
    "table": [".tsv", ".csv", ".xlsx", ".xls", ".txt", ".tab", ".parquet"],
    "script": [".py", ".r", ".sh", ".smk", ".nf", ".ipynb", ".jl", ".pl", ".sbatch", ".wdl"],
    "section": [".tex", ".md", ".docx", ".rmd", ".qmd"],
}
COMPRESSED_TABLES = [".tsv.gz", ".csv.gz", ".txt.gz"]

# Size limits in bytes and ratios.
MAX_SNAPSHOT_BYTES = 200 * 1024 * 1024
MAX_HASH_BYTES = 512 * 1024 * 1024
MIN_DEDUP_BYTES = 4096
BIG_BYTES = 4 * 1024 ** 3
RAW_MANAGED_BYTES = 50_000_000
NAME_SIMILARITY = 0.72
KEPT_SNAPSHOTS = 200

# Words a question is not searched for.
STOP_WORDS = ["the", "is", "was", "how", "what", "which", "of", "to", "in", "for", "and", "a", "it", "made",
              "created", "generated", "show", "me", "where", "did", "do", "does", "are", "with", "from", "used", "by"]
PARAM_QUESTION_WORDS = ["param", "params", "parameter", "parameters"]

# Article parts by file stem, skipped stems, reviewed parts by file.
PART_BY_STEM = {"abstract": "Abstract", "references": "References", "figures_tables": "Legends",
                "supplemental": "Supplement", "supplement": "Supplement"}
SKIPPED_STEMS = ["claims", "structure", "evidence", "numbers"]
REVIEW_PART_BY_FILE = {
    "main.tex": "Title", "sections/abstract.tex": "Summary", "sections/introduction.tex": "Introduction",
    "sections/methods.tex": "Methods", "sections/results.tex": "Results", "sections/discussion.tex": "Discussion",
    "sections/figures_tables.tex": "Figures & tables", "sections/supplemental.tex": "Supplement",
}

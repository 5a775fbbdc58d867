"""The engine's tables."""

from __future__ import annotations

FILES = "filePath string, language string, content string"
CHUNKS = "id string, filePath string, content string, language string, symbolName string, symbolKind string, startLine int, endLine int, hash string, vector array<float>, path_bucket int"
MERKLE_NODES = "path string, hash string, parentPath string, isDirectory boolean"
INDEX_STATS = "id string, totalFiles bigint, totalChunks bigint, lastIndexedAt timestamp, lastFullScanAt timestamp, overflowCount bigint, lastError string"
DEAD_LETTERS = "id string, filePath string, contentHash string, errorMessage string, attempts int, recoveryAttempts int, createdAt timestamp, updatedAt timestamp, lastRetryAt timestamp"
EMBEDDING_CACHE = "hash string, vector array<float>, dimensions int, createdAt timestamp"
FILE_EVENTS = "seq bigint, type string, filePath string, contentHash string, detectedAt timestamp"
GREP_MATCHES = "filePath string, lineNumber int, lineText string, submatches array<struct<start:int,end:int,match:string>>"
METRICS = "name string, help string, type string, labels map<string,string>, metricName string, value double, ts timestamp"
DECLARATIONS = "filePath string, language string, type string, name string, startLine int, endLine int, content string"

#: The kinds a chunk's symbol can have.
SYMBOL_KINDS = (
    "file", "module", "namespace", "class", "interface", "typeAlias", "enum", "function",
    "method", "property", "variable", "constant", "constructor", "import", "comment", "unknown",
)

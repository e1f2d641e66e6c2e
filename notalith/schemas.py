"""Schemas of the engine's tables, and constants of its ranking."""

from __future__ import annotations

META = "struct<title: string, aliases: array<string>, tags: array<string>, project: string, type: string, status: string, canonical: boolean, canonical_ref: string, created: string, updated: string, custom: map<string, string>>"
DOCS = f"file string, raw string, md5 string, mtime timestamp, title string, meta {META}"
BLOCK = "struct<type: string, level: int, heading: string, text: string, start_line: int, end_line: int>"
PIECE = "struct<heading: string, heading_path: array<string>, text: string, start_line: int, end_line: int>"
CHUNKS = f"chunk_id bigint, file string, title string, heading string, heading_path array<string>, text string, vec array<float>, chunk_hash string, start_line int, end_line int, meta {META}, mtime timestamp"
POSTINGS, LENGTHS = "term string, chunk_id bigint, tf double", "chunk_id bigint, len double"
EDGES = "src string, dst string, raw string, line int"
SCHEMA_VERSION = 3

#: Fixed values of the ranking.
K_SEARCH, K_ASK, K_FEDERATED = 6, 5, 10
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
WEIGHTS = {"title": 3.0, "aliases": 3.0, "heading_path": 1.8, "body": 1.0}
FUZZY_WEIGHT, FUZZY_MIN, FUZZY_MOST = 2.0, 3, 2
ANN_THRESHOLD, NPROBE, IVF_MOST, IVF_ROUNDS = 500, 8, 256, 20
DAMPING, RANK_ROUNDS, RANK_TOLERANCE = 0.85, 30, 1e-6
HOPS, DECAY, SEEDS = 2, 0.5, 10
MAX_QUERY = 2048
CHUNK_FILE, CHUNK_BARE, CHUNK_LEAST, CHUNK_MOST, MIN_SOLID = 1400, 1200, 100, 8192, 24
SNIPPET = 220

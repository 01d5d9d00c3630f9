"""chirpflow — post analytics on Spark.

Lazy DataFrame-to-DataFrame building blocks for a social-post corpus:
ingest and cleaning, reply threads, word usage over time and spikes, and
exact / keyword / hybrid search over post embeddings.

Sub-packages:
    sources    readers for posts CSV, account archives, JSON lines, stopwords;
               sinks; fixtures that shape the driver tables into post tables
    functions  column expressions (tokenizers, dates, vector maths, snippets)
    operators  DataFrame operators (cleaning, threads, trends, search, ...)
    plans      composed user-level queries and the query registry
    streaming  Structured Streaming ingest
"""

from chirpflow.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"

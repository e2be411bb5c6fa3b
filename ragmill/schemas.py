"""Schemas of samples, pages, chunks, vectors and results. Readers use them, so nothing is inferred."""

PAGE = "struct<url:string,title:string,last_modified:string,text:string,tables:array<struct<index:int,rows:array<array<string>>>>,infobox:array<array<string>>,categories:array<string>,references:array<string>,images:array<string>>"
SAMPLE = f"sample_id string, id string, question string, answer string, gold_passages array<string>, document_text string, url string, category string, difficulty string, pages array<{PAGE}>, metadata struct<source_chunks:array<string>,bridge_entity:string>"
CHUNK = "experiment string, doc_id long, chunk_pos int, chunk_id long, text string, n_chars int"
VECTOR = "experiment string, model string, chunk_id long, embedding array<float>"
METRICS = ("mrr", "map", "ndcg", "precision", "recall", "f1_score")
KS = (1, 3, 5, 10, 20)

from lattica.plans import cluster_queries, queries, question_queries, record_queries, text_queries

__all__ = ["cluster_queries", "queries", "question_queries", "record_queries", "text_queries"]

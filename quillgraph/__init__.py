"""quillgraph: graph and table analytics expressed as Spark plans."""

"""operators of quillgraph."""

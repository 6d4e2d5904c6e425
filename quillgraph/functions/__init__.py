"""functions of quillgraph."""

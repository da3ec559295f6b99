"""lectern: Spark jobs for question answering and learning analytics over large document collections."""

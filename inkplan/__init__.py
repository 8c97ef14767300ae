"""inkplan: form intelligence over recognised text, expressed as Spark plans."""

"""Plans made from declarations: tree queries, their text form, graph models, and pipelines."""

"""weftline: set-oriented analysis of crawled pages and crawl activity on Spark."""

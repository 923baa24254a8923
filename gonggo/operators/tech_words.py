"""Fixed values of the technology dictionary."""

from __future__ import annotations

# Each technology and the lower-case spellings that stand for it.
SPELLINGS = """
Python: python, 파이썬
Java: java, 자바
C: c
C++: c++
C#: c#
JavaScript: javascript, js, 자바스크립트
TypeScript: typescript, ts, 타입스크립트
Kotlin: kotlin, 코틀린
Swift: swift, 스위프트
PHP: php
Go: go, golang
Ruby: ruby, 루비
Rust: rust, 러스트
Dart: dart, 다트
Scala: scala, 스칼라
R: r
Perl: perl
Lua: lua
Shell: shell
Bash: bash
PowerShell: powershell
Spring: spring, spring framework, 스프링
Spring Boot: springboot, 스프링부트, spring boot
Spring MVC: springmvc, spring mvc
Spring WebFlux: springwebflux, spring webflux
JPA: jpa
Hibernate: hibernate
MyBatis: mybatis
Django: django, 장고
FastAPI: fastapi
Flask: flask, 플라스크
Node.js: nodejs, node, 노드, node.js
Express: express, 익스프레스
NestJS: nestjs, nest.js, 네스트
Ruby on Rails: rubyonrails, rails, ruby on rails
Laravel: laravel, 라라벨
.NET: 닷넷, .net
ASP.NET: asp.net
GraphQL: graphql, 그래프ql
gRPC: grpc
WebSocket: websocket
REST API: restapi, restfulapi, rest api
React: react, reactjs, 리액트
Vue.js: vuejs, vue, 뷰, vue.js
Next.js: nextjs, 넥스트, next.js
Nuxt.js: nuxtjs, 넉스트, nuxt.js
Angular: angular, 앵귤러
Svelte: svelte, 스벨트
HTML: html, html5
CSS: css, css3
Redux: redux, 리덕스
Recoil: recoil
Zustand: zustand, 주스탠드
React Query: reactquery, tanstackquery, react query
Tailwind CSS: tailwindcss, tailwind, 테일윈드, tailwind css
Bootstrap: bootstrap, 부트스트랩
Styled-Components: styledcomponents
Three.js: threejs, three.js
WebGL: webgl
React Native: reactnative, rn, 리액트네이티브, react native
Flutter: flutter, 플러터
iOS: ios
Android: android, 안드로이드
SQL: sql
RDBMS: rdbms
NoSQL: nosql
MySQL: mysql
PostgreSQL: postgresql, postgres
Oracle: oracle, 오라클
MSSQL: mssql, microsoft sql server
MariaDB: mariadb, 마리아디비
MongoDB: mongodb, 몽고디비
Redis: redis, 레디스
Elasticsearch: elasticsearch, 엘라스틱서치
DynamoDB: dynamodb, 다이나모디비
Cassandra: cassandra, 카산드라
SQLite: sqlite
Firebase: firebase, 파이어베이스
Firestore: firestore
Kafka: kafka, 카프카
RabbitMQ: rabbitmq, 래빗mq
Hadoop: hadoop, 하둡
Spark: spark, 스파크
Airflow: airflow, 에어플로우
Snowflake: snowflake
AWS: aws, amazonwebservices
GCP: gcp, googlecloudplatform
Azure: azure, 애저
Docker: docker, 도커
Kubernetes: kubernetes, k8s, 쿠버네티스
Jenkins: jenkins, 젠킨스
GitHub Actions: githubactions, githubaction, github actions
CI/CD: cicd
Terraform: terraform, 테라폼
Linux: linux, 리눅스
Ubuntu: ubuntu, 우분투
CentOS: centos, 센트오에스
Nginx: nginx, 엔진엑스
Apache: apache, 아파치
Prometheus: prometheus, 프로메테우스
Grafana: grafana, 그라파나
Datadog: datadog, 데이터독
ELK Stack: elk, elk스택, elk stack
ArgoCD: argocd, 아르고cd
Serverless: serverless
AI: ai, 인공지능
ML: ml, machinelearning, 머신러닝
Deep Learning: deeplearning, dl, 딥러닝, deep learning
LLM: llm, 대규모언어모델
Generative AI: generativeai, 생성형ai, generative ai
Computer Vision: computervision, cv, 컴퓨터비전, computer vision
OCR: ocr
NLP: nlp, 자연어처리
TensorFlow: tensorflow, 텐서플로우
PyTorch: pytorch, 파이토치
Keras: keras, 케라스
YOLO: yolo, 욜로
MediaPipe: mediapipe, 미디어파이프
OpenCV: opencv, 오픈cv
Pandas: pandas, 판다스
NumPy: numpy, 넘파이
Scikit-Learn: scikitlearn, 사이킷런
Hugging Face: huggingface, 허깅페이스, hugging face
LangChain: langchain, 랭체인
LlamaIndex: llamaindex
Vector DB: vectordb, 벡터db, vector db
Milvus: milvus
ChromaDB: chromadb
Pinecone: pinecone
MLOps: mlops
MLflow: mlflow
Kubeflow: kubeflow
XGBoost: xgboost
LightGBM: lightgbm
Claude Code: claude code
Git: git, 깃
GitHub: github, 깃허브
GitLab: gitlab, 깃랩
Bitbucket: bitbucket
Jupyter Notebook: jupyternotebook, jupyter, 주피터노트북, jupyter notebook
VS Code: vscode, visualstudiocode, vs code
Visual Studio: visualstudio, visual studio
IntelliJ: intellij, 인텔리제이
Eclipse: eclipse, 이클립스
Postman: postman, 포스트맨
Swagger: swagger, 스웨거
Figma: figma, 피그마
Notion: notion
Jira: jira
Slack: slack
Ajax: ajax
DevOps: devops
AI Agent: ai agent
pnpm: pnpm
npm: npm
Yarn: yarn
Webpack: webpack, 웹팩
Vite: vite, 바이트
"""

# General words that look like technologies but tell postings apart badly.
STOP_WORDS = (
    "소프트웨어개발", "솔루션", "SI", "시스템", "네트워크", "서버", "정보보안", "Sm", "데이터", "erp",
    "문서작성", "클라이언트", "유지보수", "방화벽", "Ms office", "기술지원", "영어", "검증", "모델링",
    "전략기획", "회로설계", "재고관리", "아키텍처", "매출관리", "인터페이스", "GUI", "PPT", "PM", "회계",
    "고객관리", "핀테크", "모바일앱개발", "문서관리", "보안관제", "HTTP", "반응형웹", "포토샵",
)

# A specific technology implies a general one.
HYPERNYMS = {"Spring Boot": "Spring"}


def default_aliases() -> dict[str, str]:
    """alias -> canonical name, in dictionary order."""
    table: dict[str, str] = {}
    for line in SPELLINGS.strip().splitlines():
        name, _, spellings = line.partition(": ")
        table.update(dict.fromkeys(spellings.split(", "), name))
    return table
